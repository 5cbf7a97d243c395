"""Secret scans, in DataFrame functions only.

Base spans come from three fixed patterns. The method adds spans: a candidate is a run of token characters; a window
slides over it and the Shannon entropy of its characters is kept by incremental counts (the sum of c log2 c changes
only by the terms of the character that leaves and of the one that enters). Each class of characters (hexadecimal,
base64) has its threshold. Candidates on the allow list are suppressed: UUIDs, words without digits, and those that hold
fewer than 16 characters, or no digit or no letter, beside placeholder words and repeated alphabets. A key that only
stands beside such a word, or has one inside, is still found. Candidates that touch a base span are left to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, rows_of

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a window must exceed by class.
BITS = {"hex": 3.0, "base64": 3.6}
#: Candidates that are never secrets: UUIDs, and those of which placeholder words and alphabets leave too little.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)|x{6,}|0{8,}|abcdefgh|12345678"
LEFT = 16


#: Matches whose offsets are added up together, so that building the array is not quadratic in the number of matches.
BLOCK = 256


def located(text: Column, pattern: str, kind: str) -> Column:
    """Array of struct(kind, start, end, value) of the leftmost non-overlapping matches: gaps and matches give offsets."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    found = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"))
    none = NONE()

    def one(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        return F.struct((start + F.length(x["h"])).alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["h"])).alias("end"), x["h"].alias("value")))).alias("out"))

    def block(z: Column) -> Column:
        def own(s: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.struct(s["at"].alias("at"), none.alias("out")), one)
            return F.get(F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(s["out"], F.array(i["out"])).alias("out"))), F.lit(0))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<kind:string,start:bigint,end:bigint,value:string>>>)").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), start, own, lambda s: F.flatten(s["out"]))

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(found), block), F.lit(0))).otherwise(none)


def NONE() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string>>)")


def most_entropy(value: str, window: int = WINDOW) -> str:
    """SQL of the largest entropy of a window over a string, by incremental counts.

    The state holds how often each ASCII character is in the window, and the sum of c log2 c over those counts. A step
    takes the character that leaves and the one that enters: two counts and four terms of the sum change.
    """
    term = "if(n < 1, 0D, n * log2(n))"

    def at(n: str) -> str:
        return f"element_at(transform(array({n}), n -> {term}), 1)"

    counts = f"transform(sequence(0, 127), k -> size(filter(slice(c, 1, {window}), x -> x = k)))"
    first = f"element_at(transform(array({counts}), t -> named_struct('t', t, 'sum', aggregate(t, 0D, (a, n) -> a + {term}))), 1)"
    moved = f"named_struct('t', transform(s.t, (n, k) -> n - if(k = u, 1, 0) + if(k = v, 1, 0)), 'sum', s.sum + {at('s.t[u] - 1')} - {at('s.t[u]')} + {at('s.t[v] + 1')} - {at('s.t[v]')})"
    step = f"if(c[i - 1] = c[i + {window - 1}], s, element_at(zip_with(array(c[i - 1]), array(c[i + {window - 1}]), (u, v) -> element_at(transform(array({moved}), n -> named_struct('t', n.t, 'sum', n.sum, 'least', least(s.least, n.sum))), 1)), 1))"
    walk = f"aggregate(if(size(c) > {window}, sequence(1, size(c) - {window}), cast(array() as array<int>)), element_at(transform(array({first}), f -> named_struct('t', f.t, 'sum', f.sum, 'least', f.sum)), 1), (s, i) -> {step}, s -> log2({window}) - s.least / {window})"
    return f"element_at(transform(array(transform(split({value}, ''), x -> ascii(x))), c -> {walk}), 1)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and secrets: array of struct(kind, start, end, value), by start, then kind as listed.

    Offsets are code points in the whole text, the end is exclusive. Null and empty texts have no secrets; long texts
    and candidates take time in proportion to their length. Spans of one start come in the order of the kinds. Repeated
    rows stay, further columns go; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = rows_of(docs, doc_id="long", text="string").select("doc_id", text)
    t = F.col("text")
    rows = rows.select(
        "doc_id",
        F.filter(located(t, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 8).alias("assign"),
        located(t, ACCESS, "access").alias("access"),
        located(t, HEX, "hex").alias("hex"),
        located(t, CANDIDATE, "entropy").alias("tokens"),
    ).withColumn("base", F.concat("assign", "access", "hex"))
    high = f"""filter(tokens, x -> not x.value rlike '{UUID}' and exists(array(regexp_replace(x.value, '{PLACEHOLDER}', '')), o -> length(o) >= {LEFT} and o rlike '[0-9]' and o rlike '[A-Za-z]')
        and not exists(base, b -> b.start < x.end and x.start < b.end)
        and {most_entropy('x.value')} > if(x.value rlike '^(?:[0-9a-f]+|[0-9A-F]+)$', {BITS['hex']}D, {BITS['base64']}D))"""
    order = F.array(*map(F.lit, KINDS))
    everything = F.concat("base", F.expr(high))
    ordered = F.transform(F.array_sort(F.transform(everything, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x.alias("hit")))), lambda x: x["hit"])
    return rows.select("doc_id", ordered.alias("secrets"))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def many(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = joined(F.filter("secrets", lambda x: x["kind"] != "entropy"))
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _spans_sql(kind: str, pattern: str) -> str:
    """DuckDB SQL of the matches of a pattern in t.text with offsets, from the lengths of gaps and matches before each."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc, '{kind}' AS kind, hit AS value, (pos + before)::BIGINT AS start, (pos + before + length(hit))::BIGINT AS "end" FROM (
        SELECT doc, hit, length(gap) AS own, sum(length(gap)) OVER w AS pos, coalesce(sum(length(hit)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
            SELECT doc, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap FROM (SELECT doc, regexp_extract_all(text, '{p}') AS h, regexp_split_to_array(text, '{p}') AS g FROM t))
        WINDOW w AS (PARTITION BY doc ORDER BY i))"""


#: The same rows in DuckDB, with the entropy of every window counted anew.
ORACLE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_spans_sql("assign", ASSIGN)}) WHERE length(regexp_extract(value, '{ASSIGN.replace("'", "''")}', 2)) >= 8
    UNION ALL {_spans_sql("access", ACCESS)} UNION ALL {_spans_sql("hex", HEX)}),
tokens AS (SELECT * FROM ({_spans_sql("entropy", CANDIDATE)}) WHERE NOT regexp_matches(value, '{UUID}') AND length(regexp_replace(value, '{PLACEHOLDER}', '', 'g')) >= {LEFT} AND regexp_matches(regexp_replace(value, '{PLACEHOLDER}', '', 'g'), '[0-9]') AND regexp_matches(regexp_replace(value, '{PLACEHOLDER}', '', 'g'), '[A-Za-z]')),
scored AS (SELECT *, list_max(list_transform(range(1, greatest(length(value) - {WINDOW - 2}, 2)), lambda i: (-list_sum(list_transform(list_distinct(string_split(substr(value, i, {WINDOW}), '')), lambda c: (length(substr(value, i, {WINDOW})) - length(replace(substr(value, i, {WINDOW}), c, ''))) / {WINDOW}.0 * log2((length(substr(value, i, {WINDOW})) - length(replace(substr(value, i, {WINDOW}), c, ''))) / {WINDOW}.0)))))) AS bits FROM tokens),
high AS (SELECT doc, kind, value, start, "end" FROM scored s WHERE bits > CASE WHEN regexp_matches(value, '^([0-9a-f]+|[0-9A-F]+)$') THEN {BITS["hex"]} ELSE {BITS["base64"]} END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = s.doc AND b.start < s."end" AND s.start < b."end")),
spans AS (SELECT doc, kind, concat_ws(':', kind, start, "end") AS span, start, list_position({list(KINDS)}, kind) AS place FROM (SELECT * FROM base UNION ALL SELECT * FROM high)),
by_doc AS (SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, place) FILTER (kind <> 'entropy') AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN by_doc USING (doc)"""
