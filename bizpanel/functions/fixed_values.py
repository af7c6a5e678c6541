"""Codes and word lists the reports must agree on.

These are data, not logic. Reports take them as defaults and accept replacements.
"""

BASE_CURRENCY = "EGP"

CUSTOMER_ACCOUNTS = ("1241", "1242")
VENDOR_ACCOUNTS = ("2321", "2322")
EXPENSE_ACCOUNTS = ("4211", "4212", "4221", "4231")

COLLECTION_DOCUMENTS = ("GR", "BT", "NR")
PAYMENT_DOCUMENTS = ("GP", "BT", "NP")

TREASURY_PREFIX = "126"
BANK_PREFIX = "127"
ACCOUNT_GROUP_NAMES = {"126": "Treasury", "127": "Bank"}
NON_CASH_ACCOUNTS = ("1278", "1279", "1270")

EXPENSE_SEGMENT_ID = 9

WHITE_PREFIX = "1"
COLOR_CENTER_PREFIX = "2"
PROJECT_PREFIX = "3"
EXPORT_CUSTOMER_PREFIX = "6"
LOCAL_VENDOR_PREFIX = "N"

CUSTOMER_TYPES = ("White Customers", "Color Centers", "Projects", "Export", "Other")

RAW_AND_PACKING_TYPES = ("R", "P")
EXCLUDED_STOCK_TYPES = ("B", "S", "F")

VOUCHER_SOURCE = "NOVA"
CASH_CALL_SOURCE = "CCALL"

WORKING_STATE = "Working"
STAFF_GROUPS = ("W", "N")
STAFF_GROUP_LABELS = {"W": "Worker", "N": "Normal Employee"}
CONFIRMED_TERMINATION = 20
APPROVED_EVALUATION = 30
DAY_LEAVE_TYPE = 2

# Currency keywords of bank accounts, in order of precedence:
# (currency, marks in the upper-case bank code, marks in the lower-case bank name)
BANK_CURRENCY_MARKS = (
    ("EGP", ("EG",), ("جنيه", "egp")),
    ("USD", ("SD",), ("دولار", "usd", "dollar")),
    ("EUR", ("EU",), ("يورو", "eur", "euro")),
)

DEPARTMENT_GROUP_ORDER = (
    "Sales & Marketing",
    "Operations & Production",
    "Warehousing",
    "Logistics & Procurement",
    "Corporate Services & HR",
    "Security",
    "Services",
    "Finance",
    "IT",
    "Projects & Construction",
    "HSE (Safety & Health)",
)

DEFAULT_DEPARTMENT_GROUP = "Corporate Services & HR"

# Department names that belong to each group by exact match.
DEPARTMENT_NAMES = {
    "Sales & Marketing": (
        "ادارة المبيعات",
        "ادارة التسويق",
        "ادارة البيع المباشر",
        "ادارة مبيعات المشروعات",
        "ادارة دعم المبيعات",
        "الادارة التجارية للتصدير",
        "ادارة مراكز التلوين",
        "منسق لوجيستيات المنتج التام",
        "ادارة اللوجيستيات المنتج التام",
    ),
    "Operations & Production": (
        "ادارة الانتاج",
        "ادارة العمليات",
        "الادارة الفنية للدهانات",
        "ادارة الصيانة",
        "ادارة المعامل",
        "ادرة الانتاج",
        "اداة الانتاج",
        "ادارة التخطيط",
    ),
    "Warehousing": (
        "ادارة مخازن المنتج التام والتحميل",
        "ادارة مخزن المواد الخام",
        "ادارة مخزن PR1",
        "ادارة مخزن الهدايا",
        "9R1 ادارة مخزن",
        "ادارة مخازن المنتج اتام والتحميل",
    ),
    "Logistics & Procurement": (
        "ادارة اللوجيستيات الواردة",
        "ادارة  اللوجيستيات الواردة",
        "ادارة المشتريات",
    ),
    "Corporate Services & HR": (
        "الادارة العليا",
        "ادارة الموارد البشرية",
        "علاقات حكومية",
        "TESTER1",
    ),
    "Services": ("ادارة الخدمات",),
    "Security": ("ادارة الأمن",),
    "Finance": ("الادارة المالية",),
    "IT": ("ادارة النظم والمعلومات",),
    "Projects & Construction": ("ادارة مشاريع الانشاءات",),
    "HSE (Safety & Health)": (
        "السلامة والصحة المهنية والبيئة",
        "ادارة توكيد الجودة والسلامة والصحة المهنية  والبيئة",
    ),
}

# Fallback words, tried in this order on names without an exact match.
DEPARTMENT_WORDS = (
    (
        "Operations & Production",
        ("الانتاج", "المعامل", "الصيانة", "العمليات", "الفنية للدهانات", "انتاج"),
    ),
    (
        "Sales & Marketing",
        (
            "المبيعات",
            "التسويق",
            "البيع المباشر",
            "تصدير",
            "التلوين",
            "التجارية",
            "مبيعات",
            "منسق لوجيستيات المنتج التام",
            "اللوجيستيات المنتج التام",
        ),
    ),
    ("Warehousing", ("مخزن", "مخازن", "التحميل")),
    ("Logistics & Procurement", ("اللوجيستيات", "واردة", "المشتريات")),
    ("Security", ("الأمن", "الامن")),
    ("Services", ("الخدمات",)),
    ("Corporate Services & HR", ("الموارد البشرية", "علاقات حكومية", "العليا", "TESTER")),
    ("Finance", ("المالية",)),
    ("Operations & Production", ("التخطيط",)),
    ("IT", ("النظم", "المعلومات")),
    ("Projects & Construction", ("انشاءات", "مشاريع")),
    ("HSE (Safety & Health)", ("السلامة", "الصحة", "البيئة", "الجودة")),
)

COLLECTION_TARGET_PCT = 80
OVER_PAID_PCT = 100
EXPENSE_LIMIT_PCT = 15

# Lower bounds of the evaluation score bands, highest first.
SCORE_BANDS = ((90, "green"), (75, "blue"), (50, "orange"))

PHOTO_BASE_URL = "https://images.example.org/hr/"

LEADERBOARD_SIZE = 25
VENDOR_LIST_SIZE = 10
EVALUATION_LIST_SIZE = 4
PREVIEW_SIZE = 10
MIN_SEARCH_LENGTH = 2
