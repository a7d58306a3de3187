"""The registered queries on a small folder: against their SQL, or against brute force where SQL can't say them."""

import hashlib
import re
import zlib

import duckdb
import pytest

from inkstone.llm import queries

from .test_texts import brute_pii, brute_secrets

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_secrets_query(spark):
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, SF).collect()}
    rows = table("documents").project("doc_id, text").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        want = [(k.split("@")[0], s, e) for k, s, e in brute_secrets(t or "")]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert got[i].base_sha256 == digest(want)
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want)


def test_pii_query(spark):
    got = {r.doc_id: r for r in queries.op8_pii(spark, SF).collect()}
    rows = table("documents").project("doc_id, text").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute_pii(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone"))
        assert got[i].base_sha256 == digest(want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i].spans.split(","))


def test_language_query(spark):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    rows = table("documents").project("doc_id, text, lang").fetchall()
    langs = {lang for _, _, lang in rows if lang}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred in langs if re.search(r"[^\W\d_]", t or "") else got[i].lang_pred == "und"


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.word_bpe_path())
    got = {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}
    for i, t in table("documents").project("doc_id, text").fetchall():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decontamination_query(spark):
    """Documents that hold an item as it is are found, and none that has not half of an item's words."""
    from inkstone.llm.decontamination import words_of

    got = {r.doc_id: r for r in queries.op7_decontamination(spark, SF).collect()}
    items = [(i, words_of(t)) for i, t in table("benchmark").project("item_id, text").fetchall()]
    for d, t in table("documents").project("doc_id, text").fetchall():
        w = words_of(t)
        joined, have = " " + " ".join(w) + " ", set(w)
        assert {i for i, x in items if x and f" {' '.join(x)} " in joined} <= set(got[d].item_ids)
        by_id = dict(items)
        assert all(sum(y in have for y in by_id[i]) >= 0.5 * len(by_id[i]) for i in got[d].item_ids)
