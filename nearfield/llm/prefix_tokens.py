"""Exact token counts at every prefix, by dynamic programming over prefixes.

For byte pair merging with ordered merges, the tokens of a prefix are the tokens of a shorter prefix and one last token, and
two tokens may stand side by side exactly if no merge across their border comes due before both are complete. So the table
of a pre-token holds, for each prefix, its last token and its count; one step looks back over the tokens that end there and
takes the one that is compatible with the prefix before it. A text's table is the running sum over its pre-tokens, and inside
each the word's own table, closed at every character. Truncation and budget questions are then look-ups.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import blocks

LIMIT = 2048
END = 1 << 60


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next unused one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Counts for a byte-level merge vocabulary whose pre-tokens end in an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("another kind of tokenizer file")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.map = str.maketrans({chr(b): c for b, c in self.letters.items()})
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b, i))
        self.number: dict[str, int] = {t: i for i, t in enumerate(model["vocab"])}
        self.names = list(self.number)
        self.right: dict[int, list[tuple[str, int]]] = {}
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.fits: dict[int, bool] = {}
        sound = {t for t in self.number if self._sound(t)}
        self.inner = {t: i for t, i in self.number.items() if t in sound and not t.endswith(self.suffix)}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.number.items() if t in sound and t.endswith(self.suffix)}
        self.longest = max(map(len, [*self.inner, *self.final]), default=0)
        self.known: dict[str, int] = {}
        self.within: dict[str, np.ndarray] = {}
        self.path = path
        self.library = None

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, least rank first, leftmost first; used on vocabulary entries only."""
        s = list(symbols)
        while len(s) > 1:
            r, i = min((self.rank.get((s[i], s[i + 1]), END), i) for i in range(len(s) - 1))
            if r == END:
                break
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _sound(self, token: str) -> bool:
        return self.merge(self._symbols(token)) == [token]

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at one edge of a token from single symbol to the whole, each with the rank of the merge that replaces it."""
        out, until = [], END
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            a, b, until = self.parts[token]
            token = b if side else a

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge joins pieces of neighbours a and b before both are complete, or ever after."""
        right = self.right.get(a) or self.right.setdefault(a, self._spine(self.names[a], 1))
        left = self.left.get(b) or self.left.setdefault(b, self._spine(self.names[b], 0))
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            r = self.rank.get((x, y), END)
            if r < END and r < until_x and r <= until_y:
                return False
            if until_x == END == until_y:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def _fit(self, a: int, b: int) -> bool:
        key = a << 17 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 2_000_000:  # the memo is bounded; what it forgets is found again
                self.fits.clear()
            got = self.fits[key] = self._compatible(a, b)
        return got

    def table(self, word: str) -> tuple[list[int], list[int]]:
        """For each prefix of a mapped pre-token, as if it went on: its count and last token."""
        n, inner, fits, most = len(word), self.inner, self.fits, self.longest
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - most), j):
                t = inner.get(word[i:j])
                if t is not None:
                    p = last[i]
                    if i:
                        ok = fits.get(p << 17 | t)
                        if ok is None:
                            ok = self._fit(p, t)
                        if not ok:
                            continue
                    count[j], last[j] = count[i] + 1, t
                    break
        return count, last

    def _close(self, word: str, j: int, count: list[int], last: list[int]) -> int:
        """Count of word[:j] as a whole pre-token, its last symbol marked as the end."""
        for i in range(max(0, j - self.longest), j):
            t = self.final.get(word[i:j])
            if t is not None and (i == 0 or self._fit(last[i], t)):
                return count[i] + 1
        raise ValueError(f"no tokens for {word[:j]!r}")

    def mapped(self, piece: str) -> str:
        return piece.translate(self.map) if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])

    def word_count(self, piece: str) -> int:
        """Tokens of a whole pre-token."""
        word = self.mapped(piece)
        if word in self.final:
            if len(word) == 1:
                return 1
        count, last = self.table(word[:-1])
        return self._close(word, len(word), count, last)

    def word_prefixes(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ... each as a whole pre-token."""
        word = self.mapped(piece)
        count, last = self.table(word)
        ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
        return [self._close(word, j, count, last) for j in ends]

    def normal(self, text: str) -> str:
        """NFC and lower case; runs of white space become one blank, which the split then drops anyway."""
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)]) if _ODD.search(text) else unicodedata.normalize("NFC", text).lower()

    def _pinned(self, text: str) -> list[str]:
        """Pre-tokens by the library itself: code points that are new to one of several versions of Unicode count as it sees them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or "".join(text.split()).isprintable():  # only assigned letters, digits and signs
            return self.pattern.findall(self.normal(text))
        return self._pinned(text)

    def pieces(self, text: str) -> list[str | None]:
        """Pre-tokens in order; None for a special token's string, which is one token."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out: list[str | None] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(None)
            at = m.end()
        return out + self._plain(text[at:])

    def counts(self, pieces: list[str | None]) -> np.ndarray:
        """Tokens of each pre-token."""
        known = self.known
        try:
            return np.array([known[p] for p in pieces], np.int64)
        except KeyError:
            pass
        for p in set(pieces):
            if p not in known:
                if len(known) > 1_500_000:
                    known.clear()
                    return np.array([1 if q is None else self.word_count(q) for q in pieces], np.int64)
                known[p] = 1 if p is None else self.word_count(p)
        return np.array([known[p] for p in pieces], np.int64)

    def prefix_table(self, text: str) -> np.ndarray:
        """Count at the end of each pre-token of the whole text."""
        return np.cumsum(self.counts(self.pieces(text)))

    def inside(self, piece: str | None) -> np.ndarray:
        """Tokens of piece[:1], piece[:2], ... as the end of a text; one for the whole of a special token's string."""
        if piece is None:
            return np.ones(1, np.int64)
        got = self.within.get(piece)
        if got is None:
            if len(self.within) > 200_000:
                self.within.clear()
            whole = all(self.pattern.findall(piece[:j]) == [piece[:j]] for j in range(1, min(len(piece), 4)))  # not so in 're, 'll and the like
            plain = self.word_prefixes(piece) if whole else [int(sum(map(self.word_count, self.pattern.findall(piece[:j]))) if j < len(piece) else self.word_count(piece)) for j in range(1, len(piece) + 1)]
            got = self.within[piece] = np.array(plain, np.int64)
        return got

    def every_prefix(self, text: str) -> np.ndarray:
        """Count at each character of the text's pre-tokens, as if the text ended there."""
        pieces = self.pieces(text)
        if not pieces:
            return np.zeros(0, np.int64)
        ends = np.cumsum(self.counts(pieces))
        return np.concatenate([before + self.inside(p) for before, p in zip([0, *ends[:-1].tolist()], pieces, strict=True)])

    def cut_at(self, text: str, budget: int) -> tuple[int, int, int, int]:
        """(tokens of the whole text, whole pre-tokens, characters of the next one, tokens) of the longest prefix within the budget."""
        pieces = self.pieces(text)
        ends = np.cumsum(self.counts(pieces)) if pieces else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        whole = fits_budget(ends, budget)
        before = int(ends[whole - 1]) if whole else 0
        if whole == len(pieces) or pieces[whole] is None:
            return total, whole, 0, before
        own = self.inside(pieces[whole])
        some = np.flatnonzero(before + own <= budget)
        return total, whole, int(some[-1]) + 1 if len(some) else 0, before + int(own[some[-1]]) if len(some) else before


#: A capital sigma at a word's end lowers to another letter in str.lower than letter by letter.
_ODD = regex.compile("Σ")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def fits_budget(table: np.ndarray, budget: int) -> int:
    """Pre-tokens that fit into a budget of tokens."""
    return int(np.searchsorted(table, budget, side="right"))


def prefix_tables(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, prefix_tokens, ends): the count at every character of every text's pre-tokens, and the place of each one's last character.

    Arrays are empty for null and for a text without tokens. White space outside pre-tokens has no entry: it adds no token.
    """
    where = path or tokenizer_path()

    def tabulate(batches):
        c = counter(where)
        for b in blocks(batches, text, 1 << 18):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ends = [np.cumsum([1 if p is None else len(p) for p in c.pieces(t)]).astype(np.int64) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "prefix_tokens": pa.array([c.every_prefix(t) for t in texts], pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(tabulate, "doc_id long, prefix_tokens array<bigint>, ends array<bigint>")


def truncate(docs: DataFrame, budget: int, path: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pieces_kept, n_chars_more, n_tokens_kept) for the longest prefix within the budget: whole pre-tokens, and characters of the next."""
    where = path or tokenizer_path()

    def cut(batches):
        c = counter(where)
        for b in blocks(batches, text):
            found = [c.cut_at(t or "", budget) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in found], pa.int64()) for i in range(4)]], ["doc_id", "n_tokens", "n_pieces_kept", "n_chars_more", "n_tokens_kept"])

    kind = "doc_id long, n_tokens long, n_pieces_kept long, n_chars_more long, n_tokens_kept long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(cut, kind)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, from the prefix tables, which stay inside the task.

    Null and empty texts have 0 bytes and tokens; repeated rows are counted each; other columns are ignored; an empty table
    gives no rows. fits, fits_chars: whole pre-tokens within the limit, and characters of the next one that are, too.
    """
    where = path or tokenizer_path()

    def count(batches):
        c = counter(where)
        for b in blocks(batches, text):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cuts = np.array([c.cut_at(t, limit) for t in texts], np.int64).reshape(len(texts), 4)
            n = cuts[:, 0]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n),
                    "over_limit": pa.array(n > limit),
                    "fits": pa.array(cuts[:, 1]),
                    "fits_chars": pa.array(cuts[:, 2]),
                }
            )

    kind = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long, fits_chars long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(count, kind)


def query(spark, sf_dir: str) -> DataFrame:
    """op8_token_counts over all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
