"""Schemas of the business tables. Dates are DATE columns, amounts are decimals."""

from __future__ import annotations

import re

# DDL of each table, as taken by DataFrameReader.schema.
SCHEMAS = {
    "journal_line": """account string, journal_no string, journal_date date,
        debit_book decimal(18,5), credit_book decimal(18,5),
        debit_txn decimal(18,5), credit_txn decimal(18,5),
        line_currency string, bank string, vendor string, segment9 string""",
    "accounts_master": "account_number string, account_description string",
    "bank_accounts_master": "bank_account_number string, bank_account_name string",
    "segments_master": """segment_id int, segment_value string,
        value_description string, parent_value string""",
    "sales_header": """internal_id bigint, invoice_year int, invoice_date date,
        customer_number string, sales_person_number string,
        total_taxable_amount decimal(18,5), exchange_rate decimal(18,5),
        total_final_amount_base decimal(18,5)""",
    "sales_line": """int_id bigint, item_id bigint, invoice_date date,
        line_weight decimal(18,5), invoiced_quantity decimal(18,5)""",
    "customer_master": "customer_no string, customer_sales_person string",
    "customer_monthly_summary": """customer_no string, customer_name string,
        summary_year int, summary_month int, total_amount decimal(18,2),
        total_weight decimal(18,2), total_volume decimal(18,2)""",
    "purchase_header": """internal_id bigint, invoice_year int, invoice_date date,
        vendor_number string, vendor_type string, total_lines_amount decimal(18,5),
        total_discount decimal(18,5), invoice_exchange_rate decimal(18,5),
        invoice_currency string""",
    "purchase_line": """int_id bigint, inv_year int, item_code string, item_type string,
        price decimal(18,5), line_amount decimal(18,5), line_discount decimal(18,5)""",
    "vendor_master": "vendor_number string, vendor_extra_name string",
    "item_balance": "item_id bigint, item_code string, item_balance decimal(18,5)",
    "item_master": """item_id bigint, item_type string, item_extra_description string,
        volume decimal(18,5)""",
    "charging": """client_id int, charging_year int, charging_month int,
        card_type string, total_cards int, total_points decimal(18,2)""",
    "client_months": "charging_year int, charging_month int, bucket bigint, bitmap binary",
    "activation": """activation_year int, activation_month int, card_type string,
        total_cards int, total_points decimal(18,2)""",
    "redemption": """client_id int, redemption_year int, redemption_month int,
        gift_name string, gift_point decimal(18,2), offer_value decimal(18,2),
        source string""",
    "client_master": """glcid int, name string, created_date date, is_painter int,
        governorate_id int""",
    "governorate": "governorate_id int, name string",
    "employee": """employee_id int, full_name string, branch_name string,
        department_name string, division_name string, job_name string, report_to int,
        joining_date date, address string, contract_date date,
        contract_expired_date date, state_description string, leaving_date date,
        termination_notes string, group_code string, education string,
        is_manager int, manager_id int, image_id int, birthdate date, tel string,
        mob string""",
    "employee_master": "employee_id int, full_name string",
    "employee_salary": "employee_id int, salary_id int, salary_amount decimal(18,2)",
    "salary_master": "salary_id int, salary_name string",
    "termination": """employee_id int, termination_date date, termination_note string,
        termination_state int""",
    "kpi_evaluation": """employee_id int, evaluation_year int, evaluation_quarter int,
        kpi_id int, target_score decimal(18,2), achieved_score decimal(18,2),
        evaluate_by int, record_state int""",
    "kpi_master": "kpi_id int, kpi_description string",
    "leave_history": "employee_id int, leave_id int, leave_date date",
    "leave_master": "leave_id int, leave_name string, leave_type int, is_business_leave int",
    "leave_balance": """employee_id int, leave_master_id int, balance_year int,
        open_balance decimal(9,2), issued decimal(9,2), approve_needed decimal(9,2),
        adjustments decimal(9,2)""",
    "safety_stock": """id bigint, item_id bigint, item_code string,
        item_description string, item_type string, safety_stock decimal(18,5),
        purchasing_warehouse string, production_warehouse string, created_by string,
        created_date timestamp_ntz, last_maint_by string, last_maint_date timestamp_ntz""",
}

REQUEST_SCHEMA = "Period string, Months string, Quarter int, Year int, CustomerType string"

_COLUMN = re.compile(r"(\w+)\s+(\w+(?:\(\d+,\s*\d+\))?)")


def columns(table: str) -> list[tuple[str, str]]:
    """Name and type of each column of a table."""
    return _COLUMN.findall(SCHEMAS[table])


#: Sales headers lie by the year of their date; the stored invoice year, which may differ, is a plain column.
HEADER_YEAR = "header_year"
# Partition column of each large fact, and how it is made where the fact has no such column.
YEAR_PARTITIONS = {
    "journal_line": ("journal_year", "year(journal_date)"),
    "sales_header": ("header_year", "year(invoice_date)"),
    "sales_line": ("line_year", "year(invoice_date)"),
    "customer_monthly_summary": ("summary_year", None),
    "purchase_header": ("invoice_year", None),
    "purchase_line": ("inv_year", None),
    "charging": ("charging_year", None),
    "client_months": ("charging_year", None),
    "activation": ("activation_year", None),
    "redemption": ("redemption_year", None),
}
