"""The operators on single texts, against brute force, round trips or held-out accuracy."""

import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import pytest

from inkstone.llm import bpe, chat_format, decontamination, language_id, pii, secret_scan, warc
from inkstone.llm.char_tagger import CharTagger
from inkstone.llm.queries import TRICKY, word_bpe_path

from .helpers import corpus, edited, frame, prose


def brute_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(f"{k}@1", s, e) for s, _, e, k in sorted(out)]


def secret_texts():
    rng = random.Random(1)
    parts = ["password", "PassWd: ", "secret=", "token: ", "api_key", "APIKEY = ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGHIJ234567", "0123456789abcdef", " ", "=", ":", "é𝄞", "x" * 50, "ſecret: abcdefg", "toKen=abcdefgh"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "token=abcdef " * 5000), (None, "token=abcdef"), (0, "token=zzzzzz")]


def test_secrets_and_ledger(spark):
    rows = secret_texts()
    got, new = secret_scan.scan_history(frame(spark, rows))
    want = sorted((str(i), str(brute_secrets(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), str([(f.rule, f.start, f.end) for f in sorted(r.findings or [], key=lambda f: (f.start, ["assign@1", "access@1", "hex@1"].index(f.rule)))])) for r in got.collect()) == want
    assert new.count() == len({t or "" for _, t in rows})
    again, nothing = secret_scan.scan_history(frame(spark, rows), new)
    assert nothing.count() == 0 and again.where("findings is not null").count() == got.where("findings is not null").count()
    rules = [("assign", "2", secret_scan.RULES[0][2]), *secret_scan.RULES[1:]]
    _, only = secret_scan.scan_history(frame(spark, rows), new, rules)  # a new version of one rule
    assert {tuple(r.rules) for r in only.collect()} == {("assign@2",)}
    empty, none = secret_scan.scan_history(frame(spark, rows).limit(0))
    assert empty.count() == none.count() == 0


def test_language_id_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    held = language_id.held_out(F.col("doc_id"))
    got = language_id.predict(docs, language_id.fit(docs.where(~held))).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 10
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    model = language_id.fit(frame(spark, [(1, "the cat"), (2, "a dog"), (3, None)]))
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the the"), (None, "x" * 100_000), (4, "the the")]
    got = language_id.predict(frame(spark, rows), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (4, "en")]
    nothing = language_id.fit(frame(spark, rows).limit(0))
    assert {r.lang_pred for r in language_id.predict(frame(spark, rows), nothing).collect()} == {"und"}
    assert language_id.predict(frame(spark, rows).limit(0), model).collect() == []
    scores = language_id.ngrams("Ab", (1, 2), 1 << 10)
    assert (scores == language_id.ngrams("aB!", (1, 2), 1 << 10)).all() and len(scores) == 4 + 3


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontamination.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def many_short_texts(spark, n=40_000):
    """Texts of eight words, more than a bounded sample of documents would hold, and some of several passages."""
    words = "concat_ws(' ', transform(sequence(1, if(id % 4000 = 7, 150, 8)), j -> concat('w', pmod(hash(id, j), 40 + 260 * (id % 2)))))"
    return spark.range(0, n, 1, 4).selectExpr("id as doc_id", f"{words} as text")


def space_of_all(texts, items):
    """Brute force for the latent space, as a projection: every passage of every text, counted in a dense matrix."""
    number = {}
    for t in items:
        for w in decontamination.words_of(t):
            number.setdefault(w, len(number))
    held = [decontamination.words_of(t) for t in texts]
    df = np.zeros(len(number))
    for w in held:
        df[[number[x] for x in set(w) if x in number]] += 1
    idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def rows(passages):
        counts = np.zeros((len(passages), len(number)))
        for i, w in enumerate(passages):
            for x in w:
                if x in number:
                    counts[i, number[x]] += 1
        a = (counts * idf)[counts.any(1)]
        return a / np.linalg.norm(a, axis=1, keepdims=True)

    a, b = rows([w[k : k + decontamination.PASSAGE] for w in held for k in range(0, len(w), decontamination.PASSAGE)]), rows([decontamination.words_of(t) for t in items])
    q = np.linalg.qr(np.random.default_rng(17).standard_normal((len(number), decontamination.RANK + decontamination.OVERSAMPLE)))[0]
    u = np.linalg.svd(a.T @ (a @ q) + max(1.0, len(a) / len(b)) * (b.T @ (b @ q)), full_matrices=False)[0][:, : decontamination.RANK]
    return u @ u.T


def fitted(monkeypatch):
    """The latent spaces that are fitted from now on, as projections."""
    out, real = [], decontamination.latent_space

    def kept(*args, **names):
        v = real(*args, **names).astype(np.float64)
        out.append(v @ v.T)
        return v.astype(np.float32)

    monkeypatch.setattr(decontamination, "latent_space", kept)
    return out


def test_decontamination_fits_on_every_passage(spark, monkeypatch):
    """However many documents there are, the latent space is that of all of them, none left out by a hash."""
    rng, docs, spaces = random.Random(21), many_short_texts(spark), fitted(monkeypatch)
    items = [prose(rng, 30, 300) for _ in range(40)]
    decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = space_of_all([r.text for r in docs.collect()], items)
    assert len(spaces) == 1 and np.linalg.norm(spaces[0] - want) < 1e-3 * np.linalg.norm(want)


def test_sums_over_passages_in_pieces(monkeypatch):
    """Few words and groups at once, passages and words that cross pieces, unknown words: the sums are those of A'A Q."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 31, n) * (rng.random(n) < 0.8) for n in (0, 1, 64, 65, 700, 3, 128, 0, 5000)] + [np.zeros(70, np.int64)]
    idf, q = rng.random(30).astype(np.float32) + np.float32(0.1), rng.standard_normal((30, 12))
    a = np.array([np.bincount(t[k : k + 64], minlength=31)[1:] * idf for t in texts for k in range(0, len(t), 64)])
    a = a[a.any(1)] / np.linalg.norm(a[a.any(1)], axis=1, keepdims=True)
    held = type("Held", (), {"value": (idf, np.vstack([idf[:, None] * q, np.zeros(12)]).astype(np.float32))})
    raws = [t.astype("<i4").tobytes() for t in texts]
    monkeypatch.setattr(decontamination, "ROWS", 8)
    for words, groups in ((1 << 16, 512), (100, 3), (1, 1)):
        monkeypatch.setattr(decontamination, "HELD_WORDS", words)
        monkeypatch.setattr(decontamination, "HELD_GROUPS", groups)
        batches = [pd.DataFrame({"words": raws[:4]}), pd.DataFrame({"words": raws[4:]}), pd.DataFrame({"words": raws[:0]})]
        tasks = [pd.concat(decontamination._power(held)(iter(b))) for b in (batches, batches[:1])]
        assert all(t.block.tolist() == [-1, 0, 1, 2, 3] for t in tasks)
        twice = pd.concat(decontamination._added(iter(tasks))).set_index("block")["sums"].map(np.frombuffer)
        once = tasks[1].set_index("block")["sums"].map(np.frombuffer)
        got = {k: twice[k] - once[k] for k in twice.index}
        assert got[-1].tolist() == [len(a)]
        assert np.allclose(np.concatenate([got[k] for k in range(4)]).reshape(30, 12), a.T @ (a @ q), rtol=1e-4, atol=1e-4)


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([12, 20, 45, 90]), 2000) + ". " + prose(rng, 4, 2000) + ".") for k in range(25)]
    rows, planted = [], {}
    for i in range(300):
        text = prose(rng, 200, 2000)
        if i % 6 == 0:
            k, t = items[i // 6 % 25]
            w = text.split(" ")
            at = rng.randrange(len(w))
            # a copy, or a paraphrase with some words changed and the answer as it is
            t = t if i % 12 else edited(rng, t.rpartition(". ")[0], len(t.split()) // 8) + ". " + t.rpartition(". ")[2]
            text = " ".join(w[:at]) + "\n" + t.upper() + " " + " ".join(w[at:])
            planted[i] = k
        rows.append((i, text))
    rows += [(300, None), (301, ""), (302, items[0][1]), (None, items[1][1]), (302, items[0][1])]
    planted[302] = 0
    bench = spark.createDataFrame([(k, t, "x") for k, t in items] + [(None, "a b", "x"), (99, None, "x"), (98, " ", "x")], "item_id long, text string, doc_id string")
    got = decontamination.flags(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.item_ids[0] for r in got if r.contaminated and r.doc_id is not None} == planted
    assert [r.contaminated for r in got if r.doc_id is None] == [True]
    assert decontamination.flags(frame(spark, rows).limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontamination.flags(frame(spark, rows), bench.limit(0)).collect())


@pytest.mark.parametrize("n_items", [40, 400, 1500])
def test_decontamination_finds_all_copies(spark, n_items):
    """Against brute force, however many items there are: long ones of rare words, and common words beside rarer ones."""
    rng = random.Random(n_items)
    common = lambda n: " ".join(f"c{rng.randrange(30)}" for _ in range(n))
    items = [(k, common(rng.choice([9, 17, 20])) if k % 4 == 0 else prose(rng, rng.choice([3, 5, 9, 17, 33, 60]), 20 * n_items)) for k in range(n_items)]
    rows = []
    for i in range(24):  # copies, some with words changed or put in, between words of other items
        t = edited(rng, items[i][1], i % 3 if len(items[i][1].split()) > 15 else 0)
        rare = [" ".join(rng.choice(items[j][1].split()) for j in rng.sample([j for j in range(n_items) if j % 4], 25)) for _ in "ab"]
        rows.append((i, "x " * i + rare[0] + " " + t.replace(" ", " and ", i % 5 // 3) + " " + rare[1]))
    rows += [(i, common(60)) for i in range(24, 90)]
    got = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, t in rows:
        w = t.split()
        for k, text in items:
            x = text.split()
            span = 16
            while span < len(x):
                span *= 2
            for s in range(-span // 2, len(w), span // 2):
                window = w[max(0, s) : s + 2 * span]
                least = max(decontamination.COPY * len(x), min(decontamination.LEAST_WORDS, len(x)))
                if len(set(window) & set(x)) >= 0.3 * len(set(x)) and sum(y in set(window) for y in x) >= least:
                    numbers = {y: j for j, y in enumerate({*x, *window})}
                    if decontamination.common_subsequence(*(np.array([numbers[y] for y in z]) for z in (x, window))) >= least:
                        want.add((i, k))
    assert {(i, i) for i in range(24)} <= want
    assert want <= {(r.doc_id, r.item_id) for r in got}


def luhn(n):
    return sum((lambda d: d - 9 if d > 9 else d)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(n))) % 10 == 0


def brute_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def pii_texts():
    rng = random.Random(2)
    parts = ["bob", "@", "a.b", ".com", "x@y.z", "1", "25", "255", "256", ".", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "+1 (555) 123-4567", "(", ")", "é𝄞", "word ", "@@", "%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(1500)] + ["1.2.3.4.5.6.7.8.9", "+" * 5000, "@" * 5000, "a" * 20000 + "@b.c", "9" * 20000, "1." * 5000]


def test_pii_rules_are_the_patterns():
    for t in pii_texts():
        assert pii.base_spans(t) == brute_pii(t), t[:200]


def test_pii_query_keeps_base_spans(spark):
    texts = pii_texts()[:300]
    rows = [*enumerate(texts), (300, None), (301, ""), (None, "x@y.zz"), (0, texts[0])]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == brute_pii(r.text or "")
        assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
    assert pii.find_pii(frame(spark, rows).limit(0)).collect() == []
    (clean,) = pii.find_pii(frame(spark, [(1, "no data here")])).collect()
    assert clean.spans == []


def test_tagger_learns_and_reconciles_windows():
    rng, texts = random.Random(3), []
    for _ in range(150):
        texts.append(prose(rng, 9) + f" u{rng.randrange(99)}@m{rng.randrange(9)}.example.com " + prose(rng, 5) + f" {rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(9)} " + prose(rng, 3))
    import pandas as pd

    got = pd.concat(pii._training(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))
    tagger = CharTagger(pii.KINDS)
    tagger.fit(np.stack([np.frombuffer(v, np.int16) for v in got.x]).astype(int), np.stack([np.frombuffer(v, np.int8) for v in got.tags]).astype(int), epochs=8)
    want = [set(pii.base_spans(t)) for t in texts]
    hits = sum(len(w & set(g)) for w, g in zip(want, pii.tag_texts(tagger, texts), strict=True))
    assert hits >= 0.8 * sum(map(len, want))
    long = " ".join(texts)
    assert len(set(pii.base_spans(long)) & set(pii.tag_texts(tagger, [long])[0])) >= 0.75 * len(pii.base_spans(long))


def test_tagger_gradients():
    t, r = CharTagger(["a", "b"], width=4, hidden=3), np.random.default_rng(0)
    x, y = r.integers(1, 20, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 0, 1, 2, 2], [3, 4, 4, 0, 0, 1]])
    _, g = t.loss(x, y)
    for k, v in t.p.items():
        i = (x[0, 0], 1) if k == "emb" else tuple(r.integers(0, s) for s in v.shape)
        old, e = v[i], 1e-5
        v[i] = old + e
        up, _ = t.loss(x, y)
        v[i] = old - e
        down, _ = t.loss(x, y)
        v[i] = old
        assert abs(g[k][i] - (up - down) / (2 * e)) < 1e-6, k


def test_tagger_finds_what_the_rules_miss():
    """Held-out spans, rewritten so that no rule finds them, in texts of their own; nothing is added to clean texts."""
    import pandas as pd

    rng = random.Random(8)

    def some(kind):
        if kind == "email":
            return f"{prose(rng, 1)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        if kind == "ip":
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == "phone":
            return f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        d = [rng.randrange(10) for _ in range(15)]
        return next(n for c in "0123456789" if luhn(n := "4" + "".join(map(str, d[1:])) + c))

    def text(span):
        return prose(rng, rng.randrange(5, 30)) + f" {rng.randrange(5000)} " + prose(rng, 3) + f" {span} " + prose(rng, rng.randrange(5, 30)) + f" {rng.random():.4f}"

    texts = [text(some(pii.KINDS[i % 4])) for i in range(500)]
    got = pd.concat(pii._training(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))
    tagger = CharTagger(pii.KINDS)
    tagger.fit(np.stack([np.frombuffer(v, np.int16) for v in got.x]).astype(int), np.stack([np.frombuffer(v, np.int8) for v in got.tags]).astype(int), epochs=16)
    hits = n = 0
    for i in range(120):
        kind = pii.KINDS[i % 4]
        new = pii.rewritten(kind, some(kind), rng)
        t = text(new)
        at = t.index(new)
        base, every = pii.all_spans(tagger, [t])
        if pii.plausible(kind, new) and not any(s < at + len(new) and at < e for _, s, e in base[0]):
            n += 1
            hits += (kind, at, at + len(new)) in every[0]
    assert n > 80 and hits >= 0.75 * n, (hits, n)
    clean = [text(str(rng.randrange(10**9))) for _ in range(100)]
    base, every = pii.all_spans(tagger, clean)
    assert base == every


def test_windows_take_the_labels_of_the_whole_text():
    t = "w " * 40 + "first.name@mail.example.com " + "10.0.0.1 " + "x " * 60
    spans = pii.base_spans(t)
    for _, s, e in spans:
        lo, tags = pii.window_of(t, spans, s)
        assert all((tags[a - lo] % 2 == 1) and (tags[a - lo + 1 : b - lo] == tags[a - lo] + 1).all() for _, a, b in spans if lo <= a < b <= lo + pii.WINDOW)
        assert not any(a < lo < b for _, a, b in spans) and lo <= s < e <= lo + pii.WINDOW


def test_short_texts_beside_long_items(spark):
    """What is held at once follows the texts and not the longest item."""
    raws = [np.ones(n, "<i4").tobytes() for n in (0, 3, 3, 900, 70_000)]
    got = list(decontamination.bundles(raws, 1 << 17))
    assert sorted(i for places, _ in got for i in places) == [0, 1, 2, 3, 4]
    assert all(top <= max(16, 4 * max(len(raws[i]) // 4 for i in places)) for places, top in got)
    rng = random.Random(3)
    items = [(0, prose(rng, 20_000, 5000)), (1, prose(rng, 12, 5000))]
    rows = [(0, items[0][1]), (1, "a " + items[1][1]), (2, prose(rng, 3, 5000)), (3, prose(rng, 15_000, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), bench).collect()} == {(0, 0), (1, 1)}


def test_history_in_batches(spark):
    rows = secret_texts()
    whole, _ = secret_scan.scan_history(frame(spark, rows))
    parts, ledger = secret_scan.scan_in_batches(frame(spark, rows), 3)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert ledger.count() == ledger.select("blob").distinct().count() == len({t or "" for _, t in rows})


def test_redaction():
    assert pii.redact("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"
    assert pii.redact("12345", [("card", 0, 3), ("phone", 2, 4)]) == "[CARD]5"


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(word_bpe_path()), random.Random(5)
    pool = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCÉéßöñçœ'’ \t\n0123½²٣,.!?中文字한국어🎉👩‍👩‍👧ΑΣσςİıſK\x1c\x85\xa0 ​　́\u0000"
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice([3, 30, 300]))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdeinth") for _ in range(rng.choice([129, 500, 5000]))) for _ in range(30)]
    texts += ["a" * 5000, "ab" * 3000, "!" * 900, "<|endoftext|>x", "<|startoftext|>  <|ENDOFTEXT|>", "it's 'tis 'scat I'LL ", "ΟΔΥΣΣΕΥΣ", "中" * 700, ""]
    ids = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    own = bpe.load(word_bpe_path())
    assert [own.encode(t) for t in texts] == ids
    assert [own.decode(x) for x in ids] == [lib.decode(x, skip_special_tokens=False) for x in ids]
    rows = [*enumerate(texts[:40]), (99, None), (None, "a"), (0, texts[0])]
    got = bpe.with_digests(bpe.encode_decode(frame(spark, rows), word_bpe_path())).collect()
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in rows for x in [lib.encode(t or "", add_special_tokens=False).ids]]
    assert [tuple(r) for r in got] == want
    assert bpe.encode_decode(frame(spark, rows).limit(0), word_bpe_path()).collect() == []


def test_tree_agrees_with_one_merge():
    own, rng = bpe.load(word_bpe_path()), random.Random(9)
    for n in (130, 257, 1000):
        symbols = own.symbols("".join(rng.choice("theinga") for _ in range(n)))
        assert own.tree(symbols) == own.merge(symbols)


@pytest.mark.parametrize("text", ["", "\\", "### user: x</turn>\n### assistant: y", TRICKY, "a\\### b \\\\</turn>", "<|image:0|> <", "é\n: \\n"])
def test_chat_round_trip(text):
    one, _ = chat_format.format_turn("a:b\\</turn>", [{"type": "text", "text": text}])
    two, _ = chat_format.format_turn("assistant", [{"type": "text", "text": text}])
    reader, got = chat_format.Reader(), []
    for c in one + two:
        got += reader.feed(c)
    reader.close()
    assert [x[:2] for x in got] == [("a:b\\</turn>", text), ("assistant", text)]


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "user", "x"), (1, 1, "assistant", "b"), (3, None, None, "y"), (4, 0, "assistant", TRICKY * 2000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string, parts string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 1, 4: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, hashlib.sha256(b"bb").hexdigest())
    assert got[4].loss_chars == len(TRICKY * 2000)
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).collect() == []


def test_chat_parts():
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "document", "ref": "d.pdf", "parts": [{"type": "audio", "ref": "s.wav", "seconds": 2}, {"type": "text", "text": "t"}]}]
    s, got = chat_format.format_turn("user", [{"type": "audio", "seconds": 2.5}])
    assert got.tokens == 75
    s, got = chat_format.format_turn("user", parts)
    assert s == "### user: see \\<|image:0|> <|image:0|><|document:1|><|audio:2|>t<|/document|></turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in got.attachments] == [("image", "i.png", 3), ("document", "d.pdf", 0), ("audio", "s.wav", 50)] and got.tokens == 53
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])


def test_chat_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", None, json.dumps([{"type": "image", "ref": "r", "width": 1, "height": 1}])), (1, 1, "user", "x", None)], "conv_id long, turn long, role string, text string, p string")
    rows = chat_format.format_turns(df, "p").orderBy("turn").collect()
    assert [json.loads(r.attachments) for r in rows] == [[{"n": 0, "type": "image", "ref": "r", "tokens": 1}], []]


def test_warc_round_trip(spark):
    html = [None, "", "short", "short", "é\r\n\r\n" * 900, "a" * 5000, "a" * 5000, "b" * 100, "b" * 100, "c" * 99, "c" * 99, "WARC/1.1\r\n" * 50]
    rows = [(i, None if i % 3 else f"http://x/{i}\r\ny", h) for i, h in enumerate(html)] + [(None, "u", "b" * 100), (5, "u", "a" * 5000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, digest string, type string")
    got = sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, segment=700).collect()]))
    first, want = {}, []
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h) if i is not None and len(b) >= 100 and first[h] != i else None
        want.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to)))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_parts():
    data = bytes(range(256)) * 40
    assert warc.unchunked(warc.chunked(data, 77)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.reassemble([2, 1, 3], [None, None, 6], [b"cd", b"ab", b"ef"]) == b"abcdef"
    for numbers, total in (([1, 3], 4), ([1, 1], 4), ([1, 2], 5)):
        with pytest.raises(ValueError):
            warc.reassemble(numbers, [None, total], [b"ab", b"cd"])
    assert list(warc.gzip_members(warc.gzip_member(b"a") + warc.gzip_member(b"") + warc.gzip_member(b"b"))) == [b"a", b"b"]


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions against what it is given: nothing clean is lost, and all that is planted goes."""
    import corpus_pipeline

    rng = random.Random(12)
    item = prose(rng, 40, 3000) + "."
    rows = [(i, prose(rng, 80, 3000)) for i in range(40)] + [(40, None), (41, "123 !"), (42, ""), (None, "some words of it")]
    rows[5] = (5, rows[4][1])
    rows[7] = (7, edited(rng, rows[6][1], 1))
    rows[9] = (9, rows[9][1] + " " + item + " " + prose(rng, 30, 3000))
    rows[11] = (11, rows[11][1] + " me@site.example.com " + rows[11][1][:40])
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "tokens" or docs.columns == before
    assert ids["language"] == {*range(40), None}
    assert ids["near_copies"] == ids["language"] - {5, 7}
    assert ids["leaks"] == ids["near_copies"] - {9}
    assert ids["personal_data"] == ids["tokens"] == ids["leaks"]
    text = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert "[EMAIL]" in text[11].text and "@" not in text[11].text and text[11].n_chars == len(text[11].text)
    assert text[3].text == dict(rows)[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["tokens"])


def test_leaks_go_by_row(spark, tmp_path):
    """A leak with a null id goes, and a clean row beside it, or with the id of a leak, stays."""
    import corpus_pipeline

    rng = random.Random(13)
    item, clean = prose(rng, 40, 3000), [prose(rng, 80, 3000) for _ in range(3)]
    leak = clean[0] + " " + item
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, clean[1]), (1, leak), (1, clean[2]), (2, leak), (2, leak), (3, clean[2]), (4, None)]
    got = corpus_pipeline.leaks(spark, frame(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, clean[1]), (1, clean[2]), (3, clean[2]), (4, None)], key=str)


def test_leaks_fit_on_every_row(spark, tmp_path, monkeypatch):
    """The stage's latent space is that of all rows it gets, with repeated texts and null ids; it takes out just the leak."""
    import corpus_pipeline

    rng, spaces = random.Random(22), fitted(monkeypatch)
    items = [prose(rng, 30, 300) for _ in range(40)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    few = [(None, "w1 w2 w3"), (5, "w4 w5 w6 w4"), (5, "w4 w5 w6 w4"), (6, "w7 w8 " + items[3])]
    docs = many_short_texts(spark).unionByName(spark.createDataFrame(few, "doc_id long, text string"))
    texts = [r.text for r in docs.collect()]
    got = [r.text for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()]
    want = space_of_all(texts, items)
    assert len(spaces) == 1 and np.linalg.norm(spaces[0] - want) < 1e-3 * np.linalg.norm(want)
    assert sorted(got) == sorted(t for t in texts if t != few[3][1])


def test_corpus_has_what_it_says():
    assert {None, "", " \n\t "} <= {t for _, t in corpus()}
