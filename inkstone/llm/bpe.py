"""BPE encoding and decoding with a public vocabulary, as the tokenizers library gives it.

Words are encoded once and remembered.  A long piece that nothing splits is cut into leaves that are encoded one by one
(any ``map`` may do so in parallel) and concatenated as a tree: around each join, a window of tokens of both sides is
encoded again, and grows until its outer tokens are those of the sides, which then agree exactly.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, tune

#: Symbols of a leaf of the tree.
LEAF = 128
#: Words remembered by a worker.
REMEMBERED = 400_000
#: Behind every merge.
NO_MERGE = (1 << 60, -1)
#: Beyond these code points a text is normalised by the library's own tables.
PLAIN = re.compile(f"[\\0-{chr(0x24F)}]*+\\Z")

# White space, and the pattern of pieces with white space spelled out.
SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = regex.compile(SUFFIXES + r"|\p{L}+|\p{N}|[^\p{L}\p{N}" + SPACE + "]+")
END = "</w>"


def _plain_pieces() -> re.Pattern:
    """The same pattern for plain texts, with the letters and numbers below U+0250 (lower case: below U+2C66) spelled out."""
    low = [chr(c) for c in range(0x250)] + [chr(c).lower() for c in range(0x250)]
    letters = "".join(sorted({c for x in low for c in x if unicodedata.category(c)[0] == "L"}))
    numbers = "".join(sorted({c for c in low if unicodedata.category(c[0])[0] == "N"}))
    return re.compile(f"{SUFFIXES}|[{letters}]+|[{numbers}]|[^{letters}{numbers}{SPACE}]+")


PLAIN_PIECES = _plain_pieces()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Words(dict):
    """Encodings of words of ordinary length; a bounded number of them."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class WordBPE:
    """The vocabulary and merges of a BPE file whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_rx = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in self.letters]  # ids of a byte within a word, and at its end
        self.final = [self.vocab.get(c + END) for c in self.letters]
        self.words = Words(self.word)

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return ids if None not in ids else [i for i in ids if i is not None]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, by rank and then from the left; for lists of a leaf's length."""
        ids, merges = list(ids), self.merges
        found = [merges.get(pair, NO_MERGE) for pair in pairwise(ids)]
        while found:
            best = min(found)
            if best is NO_MERGE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = merges.get((ids[i], ids[i + 1]), NO_MERGE)
            if i:
                found[i - 1] = merges.get((ids[i - 1], ids[i]), NO_MERGE)
        return ids

    @lru_cache(maxsize=50_000)  # noqa: B019
    def base(self, token: int) -> tuple[int, ...]:
        """The symbols that a token consists of."""
        text, out, i = self.token[token], [], 0
        while i < len(text):
            width = 1 + len(END) * (text[i + 1 :] == END)
            out.append(self.vocab[text[i : i + width]])
            i += width
        return tuple(out)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' symbols together, from the encodings of each."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            got = self.merge([*chain.from_iterable(map(self.base, left[len(left) - i :])), *chain.from_iterable(map(self.base, right[:j]))])
            fits_left = i == len(left) or got[0] == left[len(left) - i]
            fits_right = j == len(right) or got[-1] == right[j - 1]
            if fits_left and fits_right:
                return left[: len(left) - i] + got + right[j:]
            i, j = i * (1 if fits_left else 2), j * (1 if fits_right else 2)

    def tree(self, symbols: list[int], run: Callable = map) -> list[int]:
        """Leaves by ``run``, which may encode them in parallel, then joins level by level."""
        level = list(run(self.merge, [symbols[i : i + LEAF] for i in range(0, len(symbols), LEAF)]))
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def word(self, piece: str) -> tuple[int, ...]:
        symbols = self.symbols(piece)
        return tuple(self.merge(symbols) if len(symbols) <= LEAF else self.tree(symbols))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in NFC and in lower case by character; white space is in none, so it stays as it is."""
        if PLAIN.match(text):  # these are all composed, and have no final sigma
            return PLAIN_PIECES.findall(text.lower())
        return PIECES.findall(self.normalizer.normalize_str(text))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of special tokens in it are those tokens, as in the library."""
        out: list[int] = []
        for part in self.special_rx.split(text or "") if self.special_rx else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            out.extend(chain.from_iterable(map(self.words.__getitem__, self.pieces(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each whole text; null counts as empty and gives no ids.

    ``path`` is a vocabulary file that every worker can read.  Repeated rows and null ids are kept; an empty table gives
    no rows; only the two columns are read.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            ids = [bpe.encode(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    return as_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def with_digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of the ids, one space between, and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
