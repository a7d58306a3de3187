"""PII by rules and by a character-level BiLSTM-CRF that is trained here on labelled spans.

The labels are the rules' spans of whole texts, and the same spans rewritten as people write them to get past rules: with
spaces or words for signs, numbers with brackets or other separators.  Those are what the model is for.  Of every text
each stretch around a digit, a plus, an at sign or its name in brackets (no kind has a span without one) is cut into
overlapping windows; the windows' emissions are averaged where they overlap, and each stretch is decoded once as a whole.
Rule spans always stay; the model adds spans that overlap none and that are plausible for their kind.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_tagger import PAD, CharTagger, encode
from .common import hash_sample, tune

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE, CONTEXT = 64, 32, 24
#: Windows on which the model is trained, chosen by hash among all windows with a span, and at most so many of a text.
TRAIN_WINDOWS, WINDOWS_OF_TEXT = 800, 4

#: Steps of the training at least.
STEPS = 400

# The patterns and limits of the four kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # within a run of digits no later start can match
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@+]|[(\[][Aa][Tt][)\]]")
BASE_TRIGGER = re.compile(r"[0-9@+]")
AT, DOT = re.compile(r"\x20?(?:@|[(\[][Aa][Tt][)\]])\x20?"), re.compile(r"\x20?(?:\.|[(\[](?:\.|[Dd][Oo][Tt])[)\]])\x20?")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    return 14 <= len(d := digits(s)) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 10 <= len(digits(s)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each at sign backwards, so long words cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and then kind as listed."""
    if not BASE_TRIGGER.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    for kind, rx, ok in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        out += [(kind, *m.span()) for m in rx.finditer(text) if ok(m[0])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def plausible(kind: str, s: str) -> bool:
    """Whether a span of the model's can be of its kind at all: what is left once its signs are written out."""
    if kind == "email":
        return bool(EMAIL.fullmatch(DOT.sub(".", AT.sub("@", s))))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain := DOT.sub(".", s))) and is_ip(plain)
    if kind == "card":
        return is_card(s) and bool(re.fullmatch(r"[0-9]+([\x20./-]{1,3}[0-9]+)+", s))
    return is_phone(s) and bool(re.fullmatch(r"(\+|00)?\x20?[0-9(][0-9\x20()./-]+[0-9]", s)) and len(re.findall(r"[\x20()./-]+", s)) >= 2


def rewritten(kind: str, s: str, rng: random.Random) -> str:
    """A span as someone might write it to get past the rules; it is plausible, and mostly no span of theirs."""
    if kind in ("email", "ip"):
        dot = rng.choice([" . ", "[.]", "(dot)", ". "] if kind == "email" else [" . ", "[.]", ". "])
        if kind == "ip":
            return s.replace(".", dot)
        name, _, host = s.rpartition("@")
        return name + rng.choice([" @ ", "(at)", " [at] ", " (at) ", "@ "]) + (host.replace(".", dot) if rng.random() < 0.5 and dot != ". " else host)
    d, sep = digits(s), rng.choice([".", "/", " - ", "  "] if kind == "card" else [" ", "-", "."])
    if kind == "card":
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    return rng.choice([f"({d[:-7]}) {d[-7:-4]}{sep}{d[-4:]}", f"00 {d[:-7]}{sep}{d[-7:-4]}{sep}{d[-4:]}", f"{d[:-7]}{sep}{d[-7:-4]}{sep}{d[-4:]}"])


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around triggers, with their context; they don't overlap."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def window_of(text: str, spans: list[tuple[str, int, int]], start: int) -> tuple[int, np.ndarray]:
    """(where it begins, tags) of a window that holds ``start``; it begins within no span."""
    lo = max(0, min(start - 8 - (start * 7) % 13, len(text) - WINDOW))
    for _, s, e in spans:
        if s < lo < e:
            lo = s if e > start else e
    tags = np.zeros(WINDOW, np.int8)
    for k, s, e in spans:
        a, b = s - lo, min(e - lo, WINDOW)
        if 0 <= a < b and not tags[a:b].any():
            i = 1 + 2 * KINDS.index(k)
            tags[a:b], tags[a] = i + 1, i
    return lo, tags


def _training(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of each text and their tags: around base spans, around the same spans rewritten, and around other triggers.

    At most WINDOWS_OF_TEXT of each of the first two, and two or three of the last; a span that no window holds is left out.
    """
    for pdf in batches:
        rows = []
        for d, text in zip(pdf.doc_id, pdf.text, strict=True):
            n, own = 0, base_spans(text)
            some = []
            for kind, s, e in own[:WINDOWS_OF_TEXT]:
                if e - s > WINDOW - 24:
                    continue
                some.append((kind, text, own, s))
                new = rewritten(kind, text[s:e], random.Random(zlib.crc32(text[s:e].encode("utf-8", "surrogatepass"))))
                shift = len(new) - (e - s)
                if len(new) <= WINDOW - 24 and plausible(kind, new) and not any(x < e and s < y for k, x, y in own if (k, x, y) != (kind, s, e)):
                    moved = [(k, x + shift * (x >= e), y + shift * (x >= e)) for k, x, y in own if (k, x, y) != (kind, s, e)]
                    some.append((kind, text[:s] + new + text[e:], [*moved, (kind, s, s + len(new))], s))
            near, last, others = iter(own), None, []
            for m in TRIGGER.finditer(text):
                while last is None or last[2] + WINDOW <= m.start():
                    if (last := next(near, (None, len(text) + WINDOW, len(text) + 2 * WINDOW))) is None:
                        break
                if m.start() <= last[1] - WINDOW:
                    others.append(m.start())
            some += [("", text, own, s) for s in others[:: 1 + len(others) // 2][:3]]
            for kind, whole, spans, s in some:
                lo, tags = window_of(whole, spans, s)
                part = whole[lo : lo + WINDOW]
                x = np.full(WINDOW, PAD, np.int16)
                x[: len(part)] = encode(part)
                rows.append((d, n, kind, x.tobytes(), tags.tobytes()))
                n += 1
        yield pd.DataFrame(rows, columns=["doc_id", "n", "kind", "x", "tags"])


def train(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> CharTagger | None:
    """A tagger from at most ``windows`` labelled windows of the documents, or None if they have none."""
    tune(docs.sparkSession)
    found = docs.where("text is not null").mapInPandas(_training, "doc_id long, n int, kind string, x binary, tags binary")
    got = hash_sample(found.drop("doc_id", "n"), windows, "x").toPandas()
    if not len(got) or not got.kind.any():
        return None
    x = np.stack([np.frombuffer(v, np.int16) for v in got.x]).astype(np.int64)
    y = np.stack([np.frombuffer(v, np.int8) for v in got.tags]).astype(np.int64)
    tagger = CharTagger(KINDS)
    tagger.fit(x, y, epochs=max(10, -(-STEPS * 32 // len(x))))
    return tagger


def tag_texts(tagger: CharTagger, texts: list[str], group: int = 2048) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each whole text."""
    where, x = [], []
    for i, text in enumerate(texts):
        for s, e in stretches(text):
            codes = encode(text[s:e])
            for o in range(0, max(1, len(codes) - STRIDE), STRIDE):
                part = codes[o : o + WINDOW]
                x.append(np.pad(part, (0, WINDOW - len(part)), constant_values=PAD))
                where.append((i, s, e, o, len(part)))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    sums, weight, now = None, None, None

    def finish():
        i, s, _ = now
        tags = tagger.viterbi(sums / weight[:, None])
        out[i] += [(k, s + a, s + b) for k, a, b in tagger.spans(tags)]

    # a window's middle knows more of its surroundings than its ends
    taper = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for k in range(0, len(x), group):
        em = tagger.emissions(np.stack(x[k : k + group]).astype(np.int64))
        for (i, s, e, o, n), y in zip(where[k : k + group], em, strict=True):
            if now != (i, s, e):
                if now is not None:
                    finish()
                now, sums, weight = (i, s, e), np.zeros((e - s, em.shape[2])), np.zeros(e - s)
            sums[o : o + n] += y[:n] * taper[:n, None]
            weight[o : o + n] += taper[:n]
    if now is not None:
        finish()
    return out


def whole_name(text: str, start: int) -> int:
    """Where the name of an address begins: it may reach beyond the stretch that was decoded."""
    while start and text[start - 1] in LOCAL:
        start -= 1
    return start


def all_spans(model: CharTagger | None, texts: list[str]) -> tuple[list, list]:
    """The rules' spans of each text, and those with the model's."""
    base = [base_spans(t) for t in texts]
    more = tag_texts(model, texts) if model is not None else [[] for _ in texts]
    every = []
    for t, own, new in zip(texts, base, more, strict=True):
        new = [(k, whole_name(t, s) if k == "email" else s, e) for k, s, e in new]
        added = [(k, s, e) for k, s, e in new if plausible(k, t[s:e]) and not any(s < y and x < e for _, x, y in own)]
        every.append(sorted([*own, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
    return base, every


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: CharTagger | None = None) -> DataFrame:
    """(doc_id, text, base, spans) of each whole text; base: the rules' spans; spans: with the model's, all by start.

    Null texts count as empty and stay null in ``text``.  Without a labelled span there is no model, and spans are the
    base.  Repeated rows and null ids are kept; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = spark.sparkContext.broadcast(tagger or train(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, every = all_spans(held.value, [t or "" for t in pdf.text])
            as_rows = lambda spans: [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": pdf.text, "base": as_rows(base), "spans": as_rows(every)})

    return rows.mapInPandas(run, f"doc_id long, text string, base {SPAN}, spans {SPAN}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span as [KIND]; of spans that overlap, those that begin earlier."""
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(text: Column, tagger: CharTagger | None) -> Column:
    """The text with every span of the rules' and the model's as [KIND]; null stays null."""
    held = SparkSession.active().sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        _, spans = all_spans(held.value, [t or "" for t in texts])
        return pd.Series([None if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return run(text)
