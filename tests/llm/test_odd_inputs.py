"""Each operator and stage on null, empty, long and repeated rows, on empty tables, and beside columns with the names it uses itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import langid, pieces, pii, secret_scan, simhash, substrings, url_filter

RNG = np.random.default_rng(12)
PROSE = [" ".join(RNG.choice(["river", "stone", "walked", "the", "of", "home", "again,", "late."], 60)) for _ in range(6)]
SHARED = "This passage of more than a few words stands in two of the documents, and is long enough to be a unit of its own there."
ROWS = [
    (1, PROSE[0], "en", "a"), (2, PROSE[1] + "\n" + SHARED, "en", "a"), (4, PROSE[2] + "\n" + SHARED, "en", "b"), (5, PROSE[3] + " write to ann@example.com or 4539148803436467", None, None),
    (6, None, "en", "a"), (7, "", None, "a"), (8, "... 42 !!", "en", "a"), (9, PROSE[4] + " " + "word " * 60_000, "en", "c"), (10, PROSE[5], "en", "c"), (10, PROSE[5], "en", "c"), (None, PROSE[5] + " without an id", "en", "c"), (11, "password=abcd1234efgh " + PROSE[0][::-1], "xx", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names of results and of columns that the operators make on their way.
NAMES = "fingerprint component_id fp least root node secrets base spans assign entities _pii _pii_text k th h1 h2 start end removed n_removed held_out lang_pred score bits_per_byte drawn kinds place n words counts pieces ids first common size item rank".split()


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark, plain):
    return plain.select("*", *(F.lit("clash").alias(n) for n in NAMES))


def canon(df, drop=()):
    return sorted(str(tuple(v for c, v in sorted(r.asDict().items()) if c not in drop)) for r in df.collect())


def model_of(spark):
    return langid.fit_bytes([p for p in PROSE] * 4, ["en"] * 12 + ["xx"] * 12, min_count=2)


OPERATORS = {
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "secrets": lambda spark, d: secret_scan.scan(d),
    "substrings": lambda spark, d: substrings.deduplicate(d),
    "language": lambda spark, d: langid.identify(d, model_of(spark)),
    "no language": lambda spark, d: langid.identify(d, None),
    "pieces": lambda spark, d: pieces.digest(pieces.encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(spark, plain, clashing, name):
    own = OPERATORS[name]
    got = own(spark, plain)
    assert got.count() == len(ROWS)
    assert canon(own(spark, clashing)) == canon(got)
    assert own(spark, clashing.limit(0)).count() == 0


def test_pii_keeps_other_columns(spark, plain, clashing):
    got = pii.pseudonymise(clashing, "k")
    texts = {r.doc_id: r.text for r in got.collect()}
    assert got.count() == len(ROWS) and texts[6] is None and "ann@" not in texts[5] and set(got.columns) == {*clashing.columns} - {"_pii", "_pii_text"}
    assert canon(got.select("doc_id", "text", "entities")) == canon(pii.pseudonymise(plain, "k").select("doc_id", "text", "entities"))
    assert pii.pseudonymise(clashing.limit(0), "k").count() == 0


def test_urls(spark):
    weights = [0.0] * 65
    rows = [(1, "http://a.example.net/en/x"), (1, "http://a.example.net/en/x"), (2, None), (3, ""), (None, "http://x.org/fr/" + "y" * 50_000), (4, "no scheme"), (5, "://"), (6, "x://UP.NET")]
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in rows], "page_id long, url string, host string, rule string, _w string")
    got = url_filter.judge(pages, weights).collect()
    assert sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in got) == sorted([("1", "a.example.net", "example.net/en/", "allow")] * 2 + [("2", "", None, "allow"), ("3", "", None, "allow"), ("None", "x.org", "org/fr/", "allow"), ("4", "", None, "allow"), ("5", "", None, "allow"), ("6", "up.net", None, "allow")])
    assert {r.score for r in got} == {0.5} and url_filter.judge(pages.limit(0), weights).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_clean_documents(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9000, None, "en", "a", None), (9001, "", None, None, 0), (None, PROSE[0] + " " + PROSE[1], "en", "a", 9), (9003, PROSE[2], "en", "b", 5), (9003, PROSE[2], "en", "b", 5), (9004, "9 ... 9", "en", "b", 7)], docs.schema)
    given = docs.unionByName(odd)
    extra = given.withColumns({n: F.lit("clash") for n in ("fingerprint", "component_id", "score", "entities", "_row", "item_id", "lang_pred")})
    got = stage(spark, given, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    own = {r.doc_id: r for r in got.where("doc_id >= 9000 or doc_id is null").collect()}
    assert None in own and 9003 in own
    assert (9000 in own, 9004 in own) == ((False, False) if name == "language ID" else (True, True) if name != "SimHash near-dedup" else (9000 in own, 9004 in own))
    wide = stage(spark, extra, "/root/testdata/sf0.001")
    if name != "PII":  # which has a column entities of its own on its way, and gives the documents' columns back
        assert wide.columns == extra.columns
    assert canon(wide.select(*docs.columns)) == canon(got)
    assert stage(spark, given.limit(0), "/root/testdata/sf0.001").count() == 0


def test_last_stage(spark, plain, clashing):
    last = corpus_pipeline.STAGES[-1][1]
    assert canon(last(spark, plain, "")) == canon(last(spark, clashing, "")) and last(spark, plain.limit(0), "").count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    """Of each group that fingerprints at four or fewer bits link, one document stays: the least doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    prints = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b, key=lambda x: rows[x].doc_id)] = min(a, b, key=lambda x: rows[x].doc_id)
    want = {rows[find(i)].doc_id for i in range(len(rows))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
