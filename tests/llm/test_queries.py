"""Registered corpus queries over whole tables: against DuckDB where there is a
twin, else against a brute-force version or held-out labels."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from review_insights.llm import mixing, queries, toxicity
from tests.llm import brute
from tools.oracle_check import TABLES, rows_of


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def rows(con):
    return con.sql("SELECT doc_id, text FROM documents").fetchall()


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_duckdb(spark, con, sf_small, name):
    scols, srows = rows_of(run(spark, sf_small, name).toPandas())
    dcols, drows = rows_of(con.execute(queries.ORACLE[name]).df())
    assert scols == dcols and srows == drows


def test_near_duplicates(spark, sf_small, rows):
    found = sorted(map(tuple, run(spark, sf_small, "op9_ngram_join").collect()))
    assert found == sorted(r[:3] for r in brute.near_components(rows, 4, 85, 100))


def test_repeats(spark, sf_small, rows):
    found = sorted(map(tuple, run(spark, sf_small, "op5_lpf_dedup").collect()))
    assert found == sorted(brute.repeats(rows))


def test_packing_and_token_counts(spark, sf_small, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = run(spark, sf_small, "op4_packing").collect()
    padding, _ = brute.check_pieces(pieces, rows, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert padding == 0
    w = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted = sorted((i, len((x or "").encode()), n := len(w.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in rows)
    assert sorted(map(tuple, run(spark, sf_small, "op6_token_counts").collect())) == wanted


def test_languages_of_the_held_out_fold(spark, sf_small, con):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = run(spark, sf_small, "op8_language_id").collect()
    assert len(found) == len(lang)
    held = [r for r in found if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_toxicity_of_the_held_out_fold(spark, con):
    """Larger table: the smallest has a handful of labelled toxic documents."""
    sf_dir = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    held = [r for r in run(spark, sf_dir, "op2_toxicity").collect() if r["held_out"] and r["doc_id"] in toxic]
    up = sorted(held, key=lambda r: r["score"])
    ranks = [k for k, r in enumerate(up, 1) if toxic[r["doc_id"]]]
    n1, n0 = len(ranks), len(up) - len(ranks)
    assert (sum(ranks) - n1 * (n1 + 1) / 2) / (n1 * n0) >= 0.8
    assert sum(r["predicted"] for r in held if not toxic[r["doc_id"]]) <= 0.03 * n0
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in held)


def test_toxic_documents_found_in_the_held_out_fold(spark):
    """Recall at the threshold."""
    sf_dir = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    held = [r for r in run(spark, sf_dir, "op2_toxicity").collect() if r["held_out"] and toxic.get(r["doc_id"])]
    assert sum(r["predicted"] for r in held) >= 0.65 * len(held)


def test_pages(spark, sf_small, con):
    import html
    import re

    for r in run(spark, sf_small, "op10_wrapper_induction").collect():
        source = con.execute("SELECT html FROM pages WHERE page_id = ?", [r["page_id"]]).fetchall()[0][0]
        body = re.search(r"(?s)<article>(.*)</article>", source)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body.replace("<br>", " "))]
        wanted = "\n".join(p for p in parts if p)
        assert (r["text"], r["n_chars"]) == (wanted, len(wanted))


def test_pipeline_against_plain_python(spark, sf_small, con):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    model = queries.toxicity_model(spark, sf_small)
    con = con.cursor()
    docs = con.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()
    docs = [d for d in docs if model.score(d[1]) < toxicity.THRESHOLD]
    first = {}
    for d in docs:
        first.setdefault(brute.normalised(d[1]), d)
    docs = list(first.values())
    kept = {r[0] for r in brute.near_components([d[:2] for d in docs], 5, 80, 100) if r[3] or r[1] == 0}
    docs = [d for d in docs if d[0] in kept]
    con.execute("CREATE OR REPLACE TABLE left_over (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO left_over VALUES (?, ?, ?, ?)", docs)
    drawn = con.execute(f"SELECT doc_id FROM ({mixing.mixing_sql('left_over')}) WHERE sampled").fetchall()
    drawn = {i for i, in drawn}
    docs = [d[:2] for d in docs if d[0] in drawn]

    pieces = corpus_pipeline.run(spark, sf_small).collect()
    assert {p["doc_id"] for p in pieces} == {d[0] for d in docs}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    padding, _ = brute.check_pieces(pieces, docs, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert padding == 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_stages_keep_the_columns(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).schema.simpleString() == docs.schema.simpleString()
