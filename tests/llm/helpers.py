"""Small documents with all that an operator has to stand: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re

CLASHING = ["anchor", "node", "u", "v", "src", "dst", "s1", "class_id", "component", "words", "flags", "blob", "start"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=3, groups=12):
    rng, rows, i = random.Random(seed), [], 0
    passage = prose(rng, 60)
    for g in range(groups):
        base = prose(rng, rng.choice([1, 2, 4, 9, 30, 80, 150, 300]))
        for k in range(rng.randrange(1, 6)):
            rows.append((i, base if k == 1 else edited(rng, base, k % 4) if k else base))
            i += 1
        if g % 3 == 0:
            rows.append((i, prose(rng, 50) + "\n" + passage + "\t" + prose(rng, 20)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t "), (i + 3, prose(rng, 5000)), (i + 4, "É é " * 30), (i + 5, "É é " * 30), (i + 6, "x" * 3000), (0, rows[0][1]), (0, rows[0][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if n % 5 == 0 else "en", None, None if t is None else len(t), *["z"] * len(CLASHING)) for n, (i, t) in enumerate(rows)], SCHEMA)


def union_find(n_links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in n_links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return find
