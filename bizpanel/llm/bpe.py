"""BPE encoding and decoding with batched numpy merge rounds.

The tokenizer is read from its JSON file: NFC, white space to one space, lower case, a split
pattern, bytes shown as characters, and merges with a word-end mark. The texts of a chunk are split
in one array of characters. Words that a task has not met yet are merged together: their symbols
lie in one flat array, each round looks all neighbouring pairs up by binary search among the sorted
pair keys, and each word joins all places of its pair of lowest rank. Tokens of words met before
come from a bounded cache.

Decoding reads ids back as the file's decoder does: without one, tokens joined by a space.

Defined results: null and empty texts have no tokens and decode to an empty text. Strings of special
tokens in a text become those tokens. Ids of rows pass through, null and repeated ones too. Extra
columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.words import U64, mix, ragged, span_values, text_chunks

#: Words kept with their tokens in a task before the cache begins anew.
CACHE_WORDS = 300_000
#: The split pattern that the character classes below stand for.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
           0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)
_LAST = 0x110000
_NEVER = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies show for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return [table[b] for b in range(256)]


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and a 64-bit value of it; special tokens stand behind them."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    classes = np.full(_LAST + 16, _SPECIAL, np.uint8)
    classes[:_LAST] = [kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_LAST)]
    classes[_SPACES] = _SPACE
    return classes, mix(np.arange(1, len(classes) + 1, dtype=U64))


class WordBpe:
    """A BPE with word ends, from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        steps = [n["type"] for n in config["normalizer"]["normalizers"]]
        split = config["pre_tokenizer"]["pretokenizers"][0]
        known = split["pattern"]["Regex"] == SPLIT_PATTERN and split["invert"]
        if steps != ["NFC", "Replace", "Lowercase"] or not known or config["decoder"]:
            raise ValueError("a tokenizer of another kind")
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)))
        tokens = {i: t for t, i in (vocabulary | self.special).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.token_bytes = Pieces([t.encode() + b" " for t in self.tokens])
        self.id_bytes = Pieces([b"%d " % i for i in range(len(self.tokens))])
        end = model["end_of_word_suffix"]
        shown = byte_characters()
        self.inner = np.array([vocabulary[c] for c in shown], np.int64)
        self.final = np.array([vocabulary[c + end] for c in shown], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        last = np.cumsum(sizes) - 1
        symbols = self.inner[data]
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owners = [], []
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[place] == pair) & (owner[:-1] == owner[1:])
            rank = np.full(len(symbols), _NEVER)
            rank[:-1][found] = self.ranks[place[found]]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(first, append=len(symbols))
            ended = np.repeat(best == _NEVER, lengths)
            done_symbols.append(symbols[ended])
            done_owners.append(owner[ended])
            at = np.flatnonzero((rank == np.repeat(best, lengths)) & ~ended)
            # of places that overlap, as in "aaa", every other one from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[place[at]]
            keep = ~ended
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owners:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        flat, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        return flat[order], np.bincount(owners, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Puts the tokens of new words into the cache."""
        ids, sizes = self.merge(words)
        self.index.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, ids))

    def _characters(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts as one string and one array, normalised, and where each begins."""
        pieces, starts, special, at = [], np.zeros(len(texts) + 1, np.int64), [], 0
        for i, text in enumerate(texts):
            starts[i] = at
            if not text:
                continue
            marks = self.special_pattern.finditer(text) if "<|" in text else ()
            done = 0
            for m in (*marks, None):
                plain = _normal(text[done : m.start()] if m else text[done:])
                pieces.append(plain + " ")
                at += len(plain) + 1
                if m:
                    special.append((at, _LAST + list(self.special).index(m.group())))
                    pieces.append("  ")
                    at += 2
                    done = m.end()
        starts[-1] = at
        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        for place, code in special:
            codes[place] = code
        return joined, codes, starts

    def split(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts as one string and array, the words' starts and ends, and each text's first word."""
        joined, codes, starts = self._characters(texts)
        classes, _ = character_tables()
        kind = classes[codes]
        change = np.flatnonzero(np.diff(kind, prepend=255) | (kind == _NUMBER) | (kind == _SPECIAL))
        ends = np.append(change[1:], len(codes))
        word = kind[change] != _SPACE
        start, end = change[word], ends[word]
        quotes = np.flatnonzero((codes[start] == ord("'")) & (end - start == 1))
        keep = np.ones(len(start), bool)
        for q in quotes:
            if q + 1 < len(start) and start[q + 1] == end[q] and kind[start[q + 1]] == _LETTER:
                after = joined[start[q + 1] : min(end[q + 1], start[q + 1] + 2)]
                suffix = next((s for s in _SUFFIXES if after.startswith(s)), "")
                if suffix:
                    end[q] += len(suffix)
                    start[q + 1] += len(suffix)
                    keep[q + 1] = start[q + 1] < end[q + 1]
        start, end = start[keep], end[keep]
        return joined, codes, start, end, np.searchsorted(start, starts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin and the last's end."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        joined, codes, start, end, first = self.split(texts)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        values = span_values(character_tables()[1][codes], start, end)
        _, at, inverse = np.unique(values, return_index=True, return_inverse=True)
        special = codes[start[at]] >= _LAST
        words = [joined[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]
        for i in np.flatnonzero(special):
            words[i] = ""
        index = self.index
        self.learn([w for w in words if w and w not in index])
        place = np.array([index[w] if w else 0 for w in words], np.int64)
        size, begin, flat = self.size[place] if len(self.size) else place, None, self.flat
        begin = self.start[place] if len(self.size) else place
        if special.any():
            ids = list(self.special.values())
            codes_of = codes[start[at[special]]] - _LAST
            begin[special] = len(flat) + np.arange(int(special.sum()))
            size[special] = 1
            flat = np.concatenate((flat, np.array(ids, np.int64)[codes_of]))
        sizes = size[inverse]
        places = np.concatenate(([0], np.cumsum(sizes)))[first]
        return flat[ragged(begin[inverse], sizes)], places

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # lower case goes by character: a sigma at a word's end stays a plain one
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Pieces:
    """Byte strings by number, to be laid end to end."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def lay(self, numbers: np.ndarray, places: np.ndarray) -> list[bytes]:
        """The bytes of each run of numbers, without the space that ends each run."""
        size = self.size[numbers]
        flat = self.data[ragged(self.start[numbers], size)].tobytes()
        cuts = np.concatenate(([0], np.cumsum(size)))[places].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def load_bpe(path: str) -> WordBpe:
    """The tokenizer of a file, once for each Python worker."""
    return WordBpe(path)


def _coder(path: str, digests: bool):
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for chunk in text_chunks(batches, "text"):
            ids, places = bpe.encode(chunk.column("text").to_pylist())
            decoded = bpe.token_bytes.lay(ids, places)
            if digests:
                columns = [
                    pa.array([hashlib.sha256(x).hexdigest() for x in laid], pa.string())
                    for laid in (bpe.id_bytes.lay(ids, places), decoded)
                ]
            else:
                lists = pa.ListArray.from_arrays(
                    pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32))
                )
                columns = [lists, pa.array(decoded, pa.binary()).cast(pa.string())]
            counts = pa.array(np.diff(places), pa.int64())
            yield pa.RecordBatch.from_arrays([chunk.column("id"), counts, *columns], names=names)

    return run


def encode_documents(
    documents: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Tokens of each text: their number, their ids, and the text they decode to.

    With ``digests`` the SHA-256 of the ids (decimal, joined by a space) and of the decoded text
    stand in their place. ``path`` is read by the tasks and has to exist on every executor.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    coded = rows.mapInArrow(_coder(path, digests), f"id long, n_tokens long, {kinds}")
    return coded.withColumnRenamed("id", id_column)
