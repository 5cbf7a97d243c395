"""Queries by operator over the driver's tables, and SQL that must give the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import registry
from ..functions import text as X
from ..operators import corpus, documents, model, punkt, response
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A fixed linear model, so that scoring can be held against SQL: coefficient, mean, scale.
WEIGHTS = {"surface_ttr": (-0.8, 0.6, 0.12), "surface_word_entropy": (0.5, 6.5, 1.1), "surface_stopword_ratio": (-0.4, 0.25, 0.08), "surface_comma_rate": (0.3, 6.0, 3.0), "surface_hapax_ratio": (0.7, 0.7, 0.1)}
INTERCEPT = 0.2
SCALARS = list(WEIGHTS)


def docs(spark, d: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{d}/documents.parquet"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


_W = r"[\p{L}\p{N}_]+"
_TOK = f"regexp_extract_all(lower(text), '{_W}(?:''{_W})?')"
_T = f"WITH t AS (SELECT doc_id, text, lower(text) AS low, {_TOK} AS w, len({_TOK}) AS n FROM documents), x AS (SELECT doc_id, unnest(w) AS tok FROM t), c AS (SELECT doc_id, tok, count(*) AS k FROM x GROUP BY ALL)"


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _padded(pattern: str) -> str:
    """The pattern over text in which every sign stands between spaces, so that word edges are spaces."""
    body = pattern.replace(r"\b", "").replace(",? ", "\1").replace(" )?", "\3").replace(", ", "\2").replace(" ", "   ")
    return f" {body} ".replace("\1", "(?: , )?   ").replace("\2", " ,    ").replace("\3", "   )?")


_PAD = r"' ' || regexp_replace(low, '([^\p{L}\p{N}_])', ' \1 ', 'g') || ' '"


def _n(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(p, '{_padded(x)}'))" for x in patterns)


@query(f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens, CAST(len(regexp_extract_all(text, '{_W}')) AS BIGINT) AS n_words, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def word_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.tokens("text")).cast("long").alias("n_tokens"), F.size(X.words("text")).cast("long").alias("n_words"), F.md5(F.array_join(X.tokens("text"), " ")).alias("tokens_md5"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+')) AS BIGINT) AS word_count FROM documents")
def whitespace_word_count(spark, d):
    return docs(spark, d).select("doc_id", X.n_whitespace_words("text").alias("word_count"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_W}(?:''{_W})?|[.,!?;:\"''—–-]')) AS BIGINT) AS n_span_tokens, CAST(len(list_filter(regexp_extract_all(text, '{_W}'), lambda x: regexp_full_match(x, '\\p{{Nd}}+'))) AS BIGINT) AS n_integers FROM documents")
def span_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.span_tokens("text")).cast("long").alias("n_span_tokens"), X.n_integers("text").alias("n_integers"))


def clean_audit(spark, d):
    return documents.clean(docs(spark, d)).select("doc_id", "cleaned", "is_empty", "raw_char_count", "cleaned_char_count", "paragraph_count", "removed_prefixes", "removed_suffixes")


_EOL = r"replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(r"WITH a AS (SELECT doc_id, regexp_replace(" + _EOL + r", '^#+\s+[^\n]+\n+', '') AS t FROM documents) SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: regexp_replace(x, '^[\s\x{a0}\x{85}]+|[\s\x{a0}\x{85}]+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)) AS cleaned FROM a")
def header_and_paragraphs(spark, d):
    t = X.without_header(X.end_of_lines(F.col("text")))
    return docs(spark, d).select("doc_id", F.array_join(X.paragraphs(t), "\n\n").alias("cleaned"))


def _strip_ctes() -> tuple[list[str], int, str, str]:
    """CTEs of the strips one after another, how many there are, and sums of prefixes and suffixes removed."""
    sql = f"SELECT doc_id, {_EOL} AS t0, 0 AS n0 FROM documents"
    steps = [("(?i)" + p, "n") for p in L.PREFIXES] + [("(?i)" + p, "m") for p in L.SUFFIXES]
    cte, n, m = [f"s0 AS ({sql})"], [], []
    for i, (p, k) in enumerate(steps, 1):
        q = p.replace("'", "''").replace("$", r"\z")
        cte.append(f"s{i} AS (SELECT * EXCLUDE (t{i - 1}), CASE WHEN regexp_matches(t{i - 1}, '{q}') THEN 1 ELSE 0 END AS n{i}, regexp_replace(t{i - 1}, '{q}', '') AS t{i} FROM s{i - 1})")
        (n if k == "n" else m).append(f"n{i}")
    return cte, len(steps), " + ".join(n), " + ".join(m)


_STRIPS, _LAST, _NPRE, _NSUF = _strip_ctes()


@query(f"WITH {', '.join(_STRIPS)} SELECT doc_id, md5(t{_LAST}) AS stripped_md5, CAST({_NPRE} AS BIGINT) AS removed_prefixes, CAST({_NSUF} AS BIGINT) AS removed_suffixes FROM s{_LAST}")
def prefix_suffix_strip(spark, d):
    t, before, after = X.stripped(X.end_of_lines(F.col("text")))
    return docs(spark, d).select("doc_id", F.md5(t).alias("stripped_md5"), before.alias("removed_prefixes"), after.alias("removed_suffixes"))


#: Cleaned texts in place of the raw ones. DuckDB has no NFKC: rows that it would change differ.
_CLEAN = f"WITH {', '.join(_STRIPS)}, cl AS (SELECT doc_id, t{_LAST} AS t, {_NPRE} AS pre, {_NSUF} AS suf FROM s{_LAST}), cp AS (SELECT doc_id, pre, suf, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(t, ''), '^#+\\s+[^\\n]+\\n+', ''), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^[\\s\\x{{a0}}\\x{{85}}]+|[\\s\\x{{a0}}\\x{{85}}]+$', '', 'g')), lambda x: x <> '') AS ps FROM cl), cw AS (SELECT doc_id, pre, suf, len(ps) AS paragraphs, array_to_string(ps, chr(10) || chr(10)) AS cleaned FROM cp), raw AS (SELECT doc_id, coalesce(text, '') AS raw FROM documents), cd AS (SELECT cw.*, raw.raw, CAST(len(regexp_extract_all(cleaned, '[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+')) AS BIGINT) AS word_count FROM cw JOIN raw USING (doc_id)), gated AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'ERROR' WHEN word_count < 20 THEN 'INSUFFICIENT_LENGTH' ELSE 'SUCCESS' END AS status, CASE WHEN trim(raw) = '' THEN 'EMPTY_INPUT' WHEN word_count < 20 THEN 'INSUFFICIENT_LENGTH' WHEN word_count < 75 THEN 'INSUFFICIENT_EVIDENCE' END AS code FROM cd), documents AS (SELECT doc_id, cleaned AS text FROM cd)"


_PARA = r"WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]+(?:\n[^\n]+)*|\n+') AS p FROM documents), b AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM a), s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b), q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para, start, piece FROM s WHERE piece[1] <> chr(10))"


@query(_PARA + " SELECT doc_id, CAST(para AS BIGINT) AS paragraph_idx, CAST(start AS BIGINT) AS start_char, CAST(start + length(piece) AS BIGINT) AS end_char, piece AS text FROM q")
def paragraph_spans(spark, d):
    return documents.paragraph_spans(docs(spark, d))


_SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SENT = _PARA + rf", e AS (SELECT *, regexp_extract_all(piece, '(?s).+?(?:[.!?][\"''”’]?{_SPACES}+|\z)') AS z FROM q), f AS (SELECT doc_id, para, start AS ps, unnest(z) AS one, generate_subscripts(z, 1) AS i FROM e), g AS (SELECT *, ps + coalesce(sum(length(one)) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, CASE WHEN regexp_matches(one, '[.!?][\"''”’]?{_SPACES}+$') THEN regexp_replace(one, '{_SPACES}+$', '') ELSE one END AS body FROM f), sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, st) - 1 AS BIGINT) AS sentence_idx, CAST(para AS BIGINT) AS paragraph_idx, CAST(st AS BIGINT) AS start_char, CAST(st + length(body) AS BIGINT) AS end_char, body AS text FROM g WHERE regexp_replace(body, '{_SPACES}+', '', 'g') <> '')"


@query(_SENT + " SELECT * FROM sent")
def sentence_spans(spark, d):
    return documents.sentence_spans(docs(spark, d))


@query()
def punkt_abbreviations(spark, d):
    """Abbreviations of all documents with their counts and scores. SQL has no look-ahead to cut tokens with; tests hold it against a plain restatement."""
    return rounded(punkt.learn(docs(spark, d)).abbreviations, "type", "held", "bare")


@query()
def punkt_sentences(spark, d):
    """Sentences by the statistics that all documents give."""
    return punkt.sentence_spans(docs(spark, d), punkt.learn(docs(spark, d)))


@query()
def punkt_untrained(spark, d):
    """Sentences by initials, numbers and case alone, which is what is left where nothing was learned."""
    return punkt.sentence_spans(docs(spark, d))


@query(_SENT + ", o AS (SELECT doc_id, unnest(range(0, n_chars + 40, 37)) AS \"offset\" FROM documents) SELECT o.doc_id, o.\"offset\", s.sentence_idx FROM o LEFT JOIN sent s ON s.doc_id = o.doc_id AND o.\"offset\" >= s.start_char AND o.\"offset\" < s.end_char")
def sentence_at_offset(spark, d):
    """The sentence at every 37th character of each document, and past its end."""
    t = docs(spark, d)
    return documents.sentence_at(t, t.select("doc_id", F.explode(F.expr("sequence(0, n_chars + 39, 37)")).alias("offset")))


_SPANTOKEN = f"{_W}(?:''{_W})?|[.,!?;:\"''—–-]"


@query(_SENT + f" SELECT s.doc_id, count(DISTINCT paragraph_idx) AS paragraphs, count(*) AS sentences, CAST(sum(len(regexp_extract_all(s.text, '{_SPANTOKEN}'))) AS BIGINT) AS tokens, CAST(count_if(substr(d.text, CAST(start_char + 1 AS BIGINT), CAST(end_char - start_char AS BIGINT)) <> s.text) AS BIGINT) AS unfaithful FROM sent s JOIN documents d USING (doc_id) GROUP BY s.doc_id")
def span_totals(spark, d):
    """Paragraphs, sentences and tokens of each document, in the row, and spans that the text doesn't hold where they say."""
    t = docs(spark, d).select("doc_id", "text", documents.sentences(F.coalesce("text", F.lit(""))).alias("s")).where(F.size("s") > 0)
    tokens = F.aggregate(F.transform("s", lambda x: F.size(X.span_tokens(x["text"]))), F.lit(0), lambda a, n: a + n).cast("long")
    wrong = F.size(F.filter("s", lambda x: F.substr("text", (x["start"] + 1).cast("int"), F.length(x["text"])) != x["text"])).cast("long")
    return t.select("doc_id", F.size(F.array_distinct(F.transform("s", lambda x: x["paragraph_idx"]))).cast("long").alias("paragraphs"), F.size("s").cast("long").alias("sentences"), tokens.alias("tokens"), wrong.alias("unfaithful"))


def _surface(name: str, *cols: str, sql: str):
    """A query of some of the surface measurements; unused ones are pruned."""

    def f(spark, d):
        return rounded(documents.surface(docs(spark, d)).select("doc_id", *(F.col(f"surface_{c}").alias(c) for c in cols)), "doc_id")

    f.__name__ = name
    query(sql)(f)


_H = "round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6)"
_surface("char_entropy", "char_entropy", sql="WITH x AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), c AS (SELECT doc_id, ch, count(*) AS k FROM x WHERE ch <> '' GROUP BY ALL) SELECT doc_id, " + _H + " AS char_entropy FROM c GROUP BY doc_id")
_surface("word_entropy", "word_entropy", sql=f"{_T} SELECT doc_id, {_H} AS word_entropy FROM c GROUP BY doc_id")
_surface("bigram_entropy", "bigram_entropy", sql=f"{_T}, b AS (SELECT doc_id, unnest(list_zip(w[1:n - 1], w[2:n])) AS g FROM t WHERE n > 1), bc AS (SELECT doc_id, g, count(*) AS k FROM b GROUP BY ALL), h AS (SELECT doc_id, {_H} AS v FROM bc GROUP BY doc_id) SELECT t.doc_id, coalesce(v, 0.0) AS bigram_entropy FROM t LEFT JOIN h USING (doc_id)")
_surface("lexical_richness", "ttr", "root_ttr", "hapax_ratio", sql=f"{_T} SELECT doc_id, round(count(*) / sum(k), 6) AS ttr, round(count(*) / sqrt(sum(k)), 6) AS root_ttr, round(count_if(k = 1) / count(*), 6) AS hapax_ratio FROM c GROUP BY doc_id")
_surface("stopword_ratio", "stopword_ratio", sql=f"{_T} SELECT doc_id, round(count_if(tok IN {_list(L.STOPWORDS)}) / count(*), 6) AS stopword_ratio FROM x GROUP BY doc_id")
_surface("top10_concentration", "top10_concentration", sql=f"{_T}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS i, sum(k) OVER (PARTITION BY doc_id) AS n FROM c) SELECT doc_id, round(sum(k) / any_value(n), 6) AS top10_concentration FROM r WHERE i <= 10 GROUP BY doc_id")
_TAG = f"CASE WHEN v IN {_list(L.PRONOUNS)} THEN 'PRP' WHEN v IN {_list(L.PREPOSITIONS)} THEN 'IN' WHEN v IN {_list(L.BE_VERBS)} THEN 'VB' WHEN v LIKE '%ly' THEN 'RB' WHEN v LIKE '%ing' OR v LIKE '%ed' THEN 'VB' WHEN regexp_matches(v, '(tion|ment|ness)$') THEN 'NN' WHEN regexp_matches(v, '(ous|ful|ive|al)$') THEN 'JJ' ELSE 'NN' END"
_surface("pos_ratios", *(f"pos_{k}_ratio" for k in ("noun", "verb", "adj", "adv", "pronoun", "prep")), sql=f"WITH v AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x))) AS v FROM documents), g AS (SELECT doc_id, {_TAG} AS g FROM v) SELECT doc_id, " + ", ".join(f"round(count_if(g = '{t}') / count(*), 6) AS pos_{k}_ratio" for k, t in (("noun", "NN"), ("verb", "VB"), ("adj", "JJ"), ("adv", "RB"), ("pronoun", "PRP"), ("prep", "IN"))) + " FROM g GROUP BY doc_id")
_chars = lambda chars: " + ".join("length(text) - length(replace(text, '" + c.replace("'", "''") + "', ''))" for c in chars)
_surface("punctuation_rates", "comma_rate", "semicolon_rate", "colon_rate", "emdash_rate", "quote_rate", "parentheses_rate", sql=f"{_T} SELECT doc_id, " + ", ".join(f"round(CASE WHEN n = 0 THEN 0.0 ELSE ({_chars(c)}) / n * 100.0 END, 6) AS {k}_rate" for k, c in (("comma", ","), ("semicolon", ";"), ("colon", ":"), ("emdash", "—–-"), ("quote", "\"'"), ("parentheses", "()"))) + " FROM t")


@query()
def compression_ratio(spark, d):
    return rounded(documents.compression(docs(spark, d)).select("doc_id", "surface_compression_ratio"), "doc_id")


_LEN = _SENT + f", l AS (SELECT doc_id, sentence_idx, CAST(len(regexp_extract_all(text, '{_W}')) AS DOUBLE) AS v FROM sent), dd AS (SELECT doc_id, v, v - lag(v) OVER (PARTITION BY doc_id ORDER BY sentence_idx) AS dv FROM l)"


@query(_LEN + " SELECT doc_id, round(avg(v), 6) AS surface_sent_len_mean, round(median(v), 6) AS surface_sent_len_median, round(stddev_pop(v), 6) AS surface_sent_len_std, round(stddev_pop(v) / greatest(avg(v), 1e-5), 6) AS surface_sent_len_cv, round(coalesce(var_pop(dv), 0.0), 6) AS surface_sent_delta_variance, round(coalesce(avg(abs(dv)), 0.0), 6) AS surface_sent_delta_mean_abs FROM dd GROUP BY doc_id")
def sentence_rhythm(spark, d):
    names = ("sent_len_mean", "sent_len_median", "sent_len_std", "sent_len_cv", "sent_delta_variance", "sent_delta_mean_abs")
    return rounded(documents.rhythm(docs(spark, d)).select("doc_id", *(f"surface_{c}" for c in names)), "doc_id")


@query(_PARA + f", l AS (SELECT doc_id, CAST(len(regexp_extract_all(piece, '{_W}')) AS DOUBLE) AS v FROM q) SELECT doc_id, round(avg(v), 6) AS surface_para_len_mean, round(stddev_pop(v), 6) AS surface_para_len_std FROM l GROUP BY doc_id")
def paragraph_profile(spark, d):
    return rounded(documents.rhythm(docs(spark, d)).select("doc_id", "surface_para_len_mean", "surface_para_len_std"), "doc_id")


def _discourse(name: str, *cols: str, sql: str):
    def f(spark, d):
        return rounded(documents.discourse(docs(spark, d)).select("doc_id", *(F.col(f"discourse_{c}").alias(c) for c in cols)), "doc_id")

    f.__name__ = name
    query(sql)(f)


_NEAR = lambda v: f"len(list_filter(range(1, n + 1), lambda i: list_contains({'[' + _list(L.FIRST_PERSON)[1:-1] + ']'}, w[i]) AND list_has_any(w[i:i + 3], {'[' + _list(v)[1:-1] + ']'})))"
_discourse("agency", "agency_action_density", "agency_passive_density", "agency_ratio", sql=f"{_T}, a AS (SELECT doc_id, greatest(n, 1) AS n, {_NEAR(L.ACTION_VERBS)} AS a, {_NEAR(L.PASSIVE_STATE_VERBS)} AS p FROM t) SELECT doc_id, round(a / n * 100.0, 6) AS agency_action_density, round(p / n * 100.0, 6) AS agency_passive_density, round((a / n * 100.0) / greatest((a + p) / n * 100.0, 1e-5), 6) AS agency_ratio FROM a")
_P = f"{_T}, p AS (SELECT doc_id, greatest(n, 1) AS n, {_PAD} AS p FROM t)"
_discourse("reflection_density", "reflection_density", sql=f"{_P} SELECT doc_id, round(({_n(L.REFLECTION)}) / n * 100.0, 6) AS reflection_density FROM p")
_discourse("formulaic", "formulaic_moral_density", sql=f"{_P} SELECT doc_id, round(({_n(L.FORMULAIC)}) / n * 100.0, 6) AS formulaic_moral_density FROM p")
_discourse("causal_temporal", "causal_density", "temporal_density", sql=f"{_P} SELECT doc_id, round(({_n(L.CAUSAL)}) / n * 100.0, 6) AS causal_density, round(({_n(L.TEMPORAL)}) / n * 100.0, 6) AS temporal_density FROM p")
_discourse("abstract_concrete", "abstract_vocab_density", "concrete_density", "concrete_abstract_ratio", sql=f"{_T}, k AS (SELECT doc_id, greatest(n, 1) AS n, len(list_filter(w, lambda x: x IN {_list(L.ABSTRACT)})) AS a, len(list_filter(w, lambda x: x IN {_list(L.CONCRETE)})) + len(list_filter(regexp_extract_all(text, '{_W}'), lambda x: regexp_full_match(x, '\\p{{Nd}}+'))) AS c FROM t) SELECT doc_id, round(a / n * 100.0, 6) AS abstract_vocab_density, round(c / n * 100.0, 6) AS concrete_density, round((c / n * 100.0) / greatest((a + c) / n * 100.0, 1e-5), 6) AS concrete_abstract_ratio FROM k")


def _places(i: int, pattern: str) -> str:
    """Matches with the rest of their last word and what lies between them; a match counts if it is the pattern alone, as a whole word."""
    body = pattern.replace(r"\b", "")
    whole = body + r"[\p{L}\p{N}_]*"
    return f"SELECT doc_id, low, {i} AS pattern, '{body}' AS body, string_split_regex(low, '{whole}') AS gaps, regexp_extract_all(low, '{whole}') AS hits FROM t"


_REFLECTED = (
    f"{_T}, raw_hits AS ({' UNION ALL '.join(_places(i, p) for i, p in enumerate(L.REFLECTION))}), one AS (SELECT doc_id, low, pattern, body, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM raw_hits), "
    "placed AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, pattern ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM one WINDOW w AS (PARTITION BY doc_id, pattern ORDER BY i)), "
    r"bounded AS (SELECT doc_id, start / greatest(length(low), 1) AS r FROM placed WHERE regexp_full_match(hit, body) AND (start = 0 OR NOT regexp_matches(substr(low, CAST(start AS BIGINT), 1), '[\p{L}\p{N}_]'))), "
    "share AS (SELECT doc_id, count(*) AS n, count_if(r < 0.33) AS a, count_if(r >= 0.33 AND r < 0.67) AS b, count_if(r >= 0.67) AS c, avg(r) AS mean FROM bounded GROUP BY doc_id)"
)


@query(f"{_REFLECTED} SELECT doc_id, " + ", ".join(f"round(coalesce({c} / n, 0.0), 6) AS discourse_reflection_{k}" for c, k in (("a", "intro_ratio"), ("b", "body_ratio"), ("c", "conclusion_ratio"))) + ", round(coalesce(mean, 0.5), 6) AS discourse_reflection_mean_pos FROM documents LEFT JOIN share USING (doc_id)")
def reflection_position(spark, d):
    return rounded(documents.discourse(docs(spark, d)).select("doc_id", *(f"discourse_reflection_{k}" for k in ("intro_ratio", "body_ratio", "conclusion_ratio", "mean_pos"))), "doc_id")


def scalars(spark, d) -> DataFrame:
    return documents.surface(docs(spark, d)).select("doc_id", "text", "lang", "source", "n_chars", *SCALARS)


_S = f"{_T}, agg AS (SELECT doc_id, count(*) / sum(k) AS surface_ttr, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS surface_word_entropy, count_if(k = 1) / count(*) AS surface_hapax_ratio, sum(CASE WHEN tok IN {_list(L.STOPWORDS)} THEN k ELSE 0 END) / sum(k) AS surface_stopword_ratio FROM c GROUP BY doc_id), f AS (SELECT t.doc_id, coalesce(surface_ttr, 0.0) AS surface_ttr, coalesce(surface_word_entropy, 0.0) AS surface_word_entropy, coalesce(surface_stopword_ratio, 0.0) AS surface_stopword_ratio, CASE WHEN n = 0 THEN 0.0 ELSE ({_chars(',')}) / n * 100.0 END AS surface_comma_rate, coalesce(surface_hapax_ratio, 0.0) AS surface_hapax_ratio FROM t LEFT JOIN agg USING (doc_id))"


@query(f"{_S}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALARS) + " FROM f) SELECT doc_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in SCALARS) + " FROM f, m")
def standardise(spark, d):
    out = model.standardise(scalars(spark, d), SCALARS)
    return out.select("doc_id", *(F.round(c, 4).alias(c) for c in SCALARS))


_LOGIT = " + ".join(f"greatest(-3.5, least(3.5, ({c} - {m}) / {s})) * {k}" for c, (k, m, s) in WEIGHTS.items()) + f" + {INTERCEPT}"
_SCORED = f"{_S}, z AS (SELECT doc_id, {_LOGIT} AS logit FROM f), y AS (SELECT doc_id, logit, greatest(0.01, least(0.99, 1 / (1 + exp(-logit)))) AS p FROM z)"


def scored(spark, d) -> DataFrame:
    return model.score(scalars(spark, d), WEIGHTS, INTERCEPT)


@query(f"{_SCORED} SELECT doc_id, round(logit, 6) AS logit, round(p, 6) AS probability FROM y")
def logit_score(spark, d):
    return rounded(scored(spark, d).select("doc_id", "logit", "probability"), "doc_id")


@query(rf"{_SCORED}, q AS (SELECT doc_id, p, len(regexp_extract_all(text, '[^\s]+')) AS n FROM y JOIN documents USING (doc_id)) SELECT doc_id, CASE WHEN p < 0.35 THEN 'LIKELY_HUMAN' WHEN p < 0.65 THEN 'UNCERTAIN' WHEN p < 0.85 THEN 'LIKELY_AI_ASSISTED' ELSE 'LIKELY_AI_GENERATED' END AS verdict, CASE WHEN p < 0.15 AND n >= 120 THEN 'High' WHEN p < 0.35 THEN 'Moderate' WHEN p < 0.65 THEN 'Low' WHEN p > 0.9 AND n >= 120 THEN 'High' ELSE 'Moderate' END AS confidence FROM q")
def verdict(spark, d):
    return documents.verdict(scored(spark, d).withColumn("word_count", X.n_whitespace_words("text"))).select("doc_id", "verdict", "confidence")


query(f"{_CLEAN} SELECT doc_id, cleaned, cleaned = '' AS is_empty, CAST(length(raw) AS BIGINT) AS raw_char_count, CAST(length(cleaned) AS BIGINT) AS cleaned_char_count, CAST(paragraphs AS BIGINT) AS paragraph_count, CAST(pre AS BIGINT) AS removed_prefixes, CAST(suf AS BIGINT) AS removed_suffixes FROM gated")(clean_audit)


@query(f"{_CLEAN} SELECT doc_id, word_count, status, code FROM gated")
def gates(spark, d):
    return documents.gate(docs(spark, d)).select("doc_id", "word_count", "status", "code")


_LONG = f"{_S}, u AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{c}' AS feature, {c} AS observed, round(greatest(-3.5, least(3.5, ({c} - {m}) / {s})) * {k}, 4) AS impact FROM f" for i, (c, (k, m, s)) in enumerate(WEIGHTS.items())) + ")"


@query(f"{_LONG}, v AS (SELECT *, CASE WHEN impact > 0 THEN 'AI-skewed' ELSE 'Human-skewed' END AS direction FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, direction ORDER BY abs(impact) DESC, ord) AS rank FROM v) SELECT doc_id, feature, round(observed, 6) AS observed, impact, direction, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5")
def contributions_topk(spark, d):
    """By the newest version of a model's table, to which the fixed model is added."""
    path = f"{files.shared_dir(spark)}/models-{uuid.uuid4().hex}"
    files.add_version(spark, path, 1, WEIGHTS, INTERCEPT)
    return model.contributions(scalars(spark, d), SCALARS, files.newest_version(spark, path)).withColumn("observed", F.round("observed", 6))


@query()
def evidence_spans(spark, d):
    return documents.evidence(docs(spark, d))


_HITS = lambda w, values: f"len(list_filter({w}, lambda x: x IN {_list(values)}))"
_ANY = lambda patterns: " OR ".join(f"regexp_matches(p, '{_padded(x)}')" for x in patterns)
#: The rules on each sentence: a abstract, b phrase, c passive narrator, h concrete, d abstract paragraph.
_EVIDENCE = (
    f"{_SENT}, pa AS (SELECT doc_id, para, {_HITS('w', L.ABSTRACT)} AS pn, greatest(len(w), 1) AS pw FROM (SELECT doc_id, para, {_TOK.replace('text', 'piece')} AS w FROM q)), "
    f"sw AS (SELECT *, lower(text) AS low, {_TOK} AS w FROM sent), sp AS (SELECT *, {_PAD} AS p FROM sw), "
    f"sm AS (SELECT sp.*, pn, pn / pw * 100.0 AS p_density, {_HITS('w', L.ABSTRACT)} AS na, {_HITS('w', L.CONCRETE)} AS nk, greatest(len(w), 1) AS nw, {_ANY(L.FORMULAIC)} AS b, {_HITS('w', L.FIRST_PERSON)} > 0 AND {_HITS('w', L.PASSIVE_STATE_VERBS)} > 0 AND {_HITS('w', L.ACTION_VERBS)} = 0 AS c FROM sp JOIN pa ON pa.doc_id = sp.doc_id AND pa.para = sp.paragraph_idx), "
    "sa AS (SELECT *, na > 0 AS a, na >= 2 OR (na / nw * 100.0 - 1.5) / 1.2 >= 2.5 AS strong, NOT c AND nk > 0 AND na = 0 AND NOT b AS h FROM sm), "
    "sf AS (SELECT *, CASE WHEN a AND strong THEN 1.5 WHEN a THEN 1.0 ELSE 0.0 END + CASE WHEN b THEN 1.5 ELSE 0.0 END + CASE WHEN c THEN 0.6 ELSE 0.0 END AS base FROM sa), "
    "sd AS (SELECT *, base < 1.0 AND p_density >= 3.5 AND pn >= 2 AS d FROM sf), "
    "ev AS (SELECT *, round(CAST(base AS DOUBLE) + CASE WHEN d THEN 0.8 ELSE 0.0 END, 2) AS score, CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) + CAST(d AS BIGINT) AS n_ai, "
    "concat_ws(',', CASE WHEN a THEN 'discourse_abstract_vocab_density:' || CASE WHEN strong THEN 'Strong' ELSE 'Moderate' END END, CASE WHEN b THEN 'discourse_formulaic_moral_density:' || CASE WHEN a THEN 'Strong' ELSE 'Moderate' END END, CASE WHEN c THEN 'discourse_agency_passive_density:Mild' END, CASE WHEN h THEN 'discourse_concrete_sensory_density:Moderate' END, CASE WHEN d THEN 'discourse_paragraph_abstraction:Mild' END) AS rules FROM sd), "
    "sev AS (SELECT *, CASE WHEN (a AND (strong OR b)) OR score >= 1.8 THEN 'high' WHEN n_ai > 0 OR score >= 0.8 THEN 'medium' WHEN h THEN 'human_grounded' ELSE 'neutral' END AS severity FROM ev)"
)


@query(f"{_EVIDENCE} SELECT doc_id, sentence_idx, paragraph_idx, start_char, end_char, severity AS overall_severity, score AS ai_evidence_score, n_ai AS ai_evidence_count, rules FROM sev")
def sentence_evidence(spark, d):
    """The judgement of each sentence, its items as feature:strength."""
    rules = F.array_join(F.transform("items", lambda x: F.concat(x["feature_name"], F.lit(":"), x["evidence_strength"])), ",")
    return documents.evidence(docs(spark, d)).select("doc_id", "sentence_idx", "paragraph_idx", "start_char", "end_char", "overall_severity", "ai_evidence_score", "ai_evidence_count", rules.alias("rules"))


@query(f"{_EVIDENCE}, n AS (SELECT doc_id, CAST(count_if(severity IN ('high', 'medium')) AS BIGINT) AS flagged, CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'medium') AS BIGINT) AS medium, count(*) AS sentences FROM sev GROUP BY doc_id) SELECT doc_id, coalesce(flagged, 0) AS flagged, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(sentences, 0) AS sentences FROM documents LEFT JOIN n USING (doc_id)")
def severity_counts(spark, d):
    spans = docs(spark, d).select("doc_id", documents.evidence_array(F.coalesce("text", F.lit(""))).alias("s"))
    n = lambda *kinds: F.size(F.filter("s", lambda x: x["overall_severity"].isin(*kinds))).cast("long")
    return spans.select("doc_id", n("high", "medium").alias("flagged"), n("high").alias("high"), n("medium").alias("medium"), F.size("s").cast("long").alias("sentences"))


_RAWEVIDENCE = _CLEAN.rsplit(", documents AS (", 1)[0] + ", " + _EVIDENCE.removeprefix("WITH ")
_OFRAW = lambda c: f"CAST(CASE WHEN status = 'SUCCESS' THEN coalesce({c}, 0) ELSE 0 END AS BIGINT)"


@query(f"{_RAWEVIDENCE}, n AS (SELECT doc_id, count(*) AS sentences, count_if(severity IN ('high', 'medium')) AS flagged, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, md5(string_agg(start_char || ':' || end_char, ',' ORDER BY sentence_idx)) AS spans FROM sev GROUP BY doc_id), np AS (SELECT doc_id, count(*) AS runs FROM q GROUP BY doc_id) SELECT doc_id, status, code, word_count, CAST(length(raw) AS BIGINT) AS char_count, coalesce(runs, 0) AS paragraph_count, {_OFRAW('sentences')} AS sentence_count, {_OFRAW('flagged')} AS flagged_sentence_count, {_OFRAW('high')} AS high_severity_count, {_OFRAW('medium')} AS medium_severity_count, CASE WHEN status = 'SUCCESS' THEN coalesce(spans, md5('')) ELSE md5('') END AS offsets_md5 FROM gated LEFT JOIN n USING (doc_id) LEFT JOIN np USING (doc_id)")
def response_metadata(spark, d):
    """Gate, counts and a digest of the span offsets of the response, which are all of the raw text (words are of the cleaned one)."""
    out = response.with_spans(response.gated(docs(spark, d).select("doc_id", "text")))
    offsets = F.md5(F.array_join(F.transform("highlighted_spans", lambda s: F.concat_ws(":", s["start_char"].cast("string"), s["end_char"].cast("string"))), ","))
    return out.select("doc_id", "status", "code", *response.METADATA, offsets.alias("offsets_md5"))


#: Cleaned texts that are long enough, one of each, and one of those that begin alike.
_GOOD = _CLEAN.rsplit(", documents AS (", 1)[0] + rf""", good AS (SELECT doc_id, cleaned FROM gated WHERE length(regexp_replace(raw, '^{_SPACES}+|{_SPACES}+$', '', 'g')) >= 50 AND cleaned <> '' AND word_count >= 30),
uniq AS (SELECT min(doc_id) AS doc_id, cleaned FROM good GROUP BY cleaned), keyed AS (SELECT doc_id, regexp_replace(lower(substr(cleaned, 1, 60)), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS k FROM uniq),
kept AS (SELECT min(doc_id) AS doc_id FROM keyed WHERE length(k) >= 30 GROUP BY k UNION ALL SELECT doc_id FROM keyed WHERE length(k) < 30)"""


@query(f"{_GOOD} SELECT doc_id, sha256(cleaned) AS text_hash FROM uniq")
def exact_dedupe(spark, d):
    """Of documents long enough the first of each cleaned text."""
    return corpus.exact_dedupe(corpus.drop_malformed(docs(spark, d)).select("doc_id", "cleaned")).select("doc_id", "text_hash")


@query(f"{_GOOD} SELECT doc_id FROM kept")
def near_dedupe(spark, d):
    """Of those the first of each beginning."""
    return corpus.near_dedupe(corpus.exact_dedupe(corpus.drop_malformed(docs(spark, d)).select("doc_id", "cleaned"))).select("doc_id")


@query(f"{_GOOD} SELECT total, total - good AS malformed, good - uniq AS exact_duplicates, uniq - kept AS near_duplicates, kept FROM (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM good) AS good, (SELECT count(*) FROM uniq) AS uniq, (SELECT count(*) FROM kept) AS kept)")
def audit(spark, d):
    return corpus.audit(docs(spark, d))


@query("SELECT lang, source, count(*) AS n, CAST(count_if(length(text) < 350) AS BIGINT) AS short, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang, source")
def audit_tallies(spark, d):
    return rounded(docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 350).alias("short"), F.avg("n_chars").alias("mean_chars")), "lang", "source")


def _split_sql(rows: str, most: int = 64) -> str:
    """SQL that deals the groups of rows (doc_id, source, ...) one after the other, as the split does.

    The seeded order comes as a list for each number of groups, as SQL has no such generator.
    """
    orders = ", ".join(f"({n}, {np.random.RandomState(42).permutation(n).tolist()})" for n in range(1, most + 1))
    return (
        f"WITH RECURSIVE rows_ AS ({rows}), orders(n, o) AS (VALUES {orders}), g AS (SELECT source, count(*) AS k, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS place FROM rows_ GROUP BY source), "
        "total AS (SELECT sum(k) AS all_, count(*) AS n FROM g), turn AS (SELECT unnest(o) AS place, generate_subscripts(o, 1) AS t FROM orders JOIN total USING (n)), seq AS (SELECT t, source, k FROM turn JOIN g USING (place)), "
        "walk(t, source, split, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) UNION ALL "
        "SELECT seq.t, seq.source, CASE WHEN w.a < 0 OR w.a + k <= all_ * 0.7 THEN 'train' WHEN w.b < 0 OR w.b + k <= all_ * 0.15 THEN 'val' ELSE 'test' END, CASE WHEN w.a < 0 OR w.a + k <= all_ * 0.7 THEN greatest(w.a, 0) + k ELSE w.a END, "
        "CASE WHEN w.a < 0 OR w.a + k <= all_ * 0.7 THEN w.b WHEN w.b < 0 OR w.b + k <= all_ * 0.15 THEN greatest(w.b, 0) + k ELSE w.b END FROM walk w JOIN seq ON seq.t = w.t + 1, total), "
        "dealt AS (SELECT r.*, w.split FROM rows_ r JOIN walk w ON w.t > 0 AND r.source IS NOT DISTINCT FROM w.source)"
    )


_SPLIT = _split_sql("SELECT doc_id, source FROM documents")


@query(f"{_SPLIT} SELECT doc_id, source, split FROM dealt")
def grouped_split(spark, d):
    return corpus.grouped_split(docs(spark, d)).select("doc_id", "source", "split")


@query(f"{_SPLIT} SELECT source, count(DISTINCT split) AS splits FROM dealt GROUP BY source HAVING count(DISTINCT split) > 1")
def leakage_check(spark, d):
    return corpus.leaks(corpus.grouped_split(docs(spark, d)))


def judged(spark, d) -> DataFrame:
    """Labelled documents: y (not of quality), a score and the prediction from it."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    p = (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("p")
    return docs(spark, d).join(labels, "doc_id").select("doc_id", "text", "lang", "source", "toxic", (1 - F.col("quality")).alias("y"), F.expr("(size(split(text, '[ \\n]+')))").alias("words"), p).withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))


_J = r"WITH j AS (SELECT d.doc_id, d.text, lang, source, toxic, 1 - quality AS y, len(string_split_regex(d.text, '[ \n]+')) AS words, (d.doc_id * 37 % 101) / 100.0 AS p, CASE WHEN (d.doc_id * 37 % 101) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels USING (doc_id))"
_METRICS = "count(*) AS n, CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp, CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp, round(avg((p - y) * (p - y)), 6) AS brier_score, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(coalesce(count_if(y = 1 AND pred = 1) / nullif(count_if(pred = 1), 0), 0.0), 6) AS precision, round(coalesce(count_if(y = 1 AND pred = 1) / nullif(count_if(y = 1), 0), 0.0), 6) AS recall, round(coalesce(2 * count_if(y = 1 AND pred = 1) / nullif(count_if(pred = 1) + count_if(y = 1), 0), 0.0), 6) AS f1, round(coalesce(count_if(y = 0 AND pred = 1) / nullif(count_if(y = 0), 0), 0.0), 6) AS false_positive_rate, round(coalesce(count_if(y = 1 AND pred = 0) / nullif(count_if(y = 1), 0), 0.0), 6) AS false_negative_rate"


def _metrics_sql(by: str, expr: str | None = None) -> str:
    g = f"g AS (SELECT *, {expr or by} AS slice FROM j)"
    auc = "a AS (SELECT x.slice, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM g x JOIN g z ON x.slice = z.slice AND x.y = 1 AND z.y = 0 GROUP BY x.slice)"
    return f"{_J}, {g}, {auc}, m AS (SELECT slice, {_METRICS} FROM g WHERE slice IS NOT NULL GROUP BY slice) SELECT m.slice AS {by}, m.* EXCLUDE (slice), round(coalesce(auc, 0.5), 6) AS roc_auc FROM m LEFT JOIN a ON a.slice = m.slice"


@query(_metrics_sql("whole", "1").replace("m.slice AS whole, ", ""))
def confusion_metrics(spark, d):
    return rounded(model.evaluate(judged(spark, d)))


_BUCKET = "CASE WHEN words < 350 THEN 'short' WHEN words < 550 THEN 'medium' WHEN words < 10000 THEN 'long' END"


@query(_metrics_sql("bucket", _BUCKET))
def length_slices(spark, d):
    return rounded(model.evaluate(judged(spark, d).withColumn("bucket", F.expr(_BUCKET)).where("bucket is not null"), ["bucket"]), "bucket")


@query(_metrics_sql("lang"))
def topic_slices(spark, d):
    return rounded(model.evaluate(judged(spark, d), ["lang"]), "lang")


@query(f"{_J} SELECT source, count(*) AS n, round(avg(pred), 6) AS recall, round(avg(p), 6) AS mean_probability FROM j WHERE y = 1 AND source IS NOT NULL GROUP BY source")
def family_recall(spark, d):
    return rounded(judged(spark, d).where("y = 1 and source is not null").groupBy("source").agg(F.count("*").alias("n"), F.avg("pred").alias("recall"), F.avg("p").alias("mean_probability")), "source")


@query(f"{_J} SELECT y AS label, count(*) AS n, round(avg(pred), 6) AS predicted_ratio, round(avg(p), 6) AS mean_confidence FROM j GROUP BY y")
def label_slices(spark, d):
    return rounded(judged(spark, d).groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"), F.avg("pred").alias("predicted_ratio"), F.avg("p").alias("mean_confidence")), "label")


@query(f"{_J}, r AS (SELECT CAST(count_if(y = 0 AND toxic = 1) AS BIGINT) AS a, CAST(count_if(y = 0 AND toxic = 0) AS BIGINT) AS b, avg(CASE WHEN y = 0 AND toxic = 1 THEN pred END) AS ra, avg(CASE WHEN y = 0 AND toxic = 0 THEN pred END) AS rb FROM j) SELECT CASE WHEN a > 0 AND b > 0 THEN 'EVALUATED' ELSE 'INSUFFICIENT_METADATA' END AS status, round(CASE WHEN a > 0 AND b > 0 THEN ra END, 6) AS fpr_a, round(CASE WHEN a > 0 AND b > 0 THEN rb END, 6) AS fpr_b, round(CASE WHEN a > 0 AND b > 0 THEN ra / greatest(rb, 1e-5) END, 6) AS ratio FROM r")
def subgroup_disparity(spark, d):
    return rounded(model.disparity(judged(spark, d), "toxic", 1, 0))


@query(f"{_J}, a AS (SELECT 'false_positive' AS kind, doc_id, p, y, pred, lang, source, words, substr(text, 1, 300) || '...' AS snippet FROM j WHERE y = 0 AND pred = 1 ORDER BY p DESC, doc_id LIMIT 10), b AS (SELECT 'false_negative' AS kind, doc_id, p, y, pred, lang, source, words, substr(text, 1, 300) || '...' AS snippet FROM j WHERE y = 1 AND pred = 0 ORDER BY p, doc_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def failure_topk(spark, d):
    return model.failures(judged(spark, d))


@query(f"{_S} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.9), 6) AS p90 FROM f" for c in SCALARS))
def human_quantiles(spark, d):
    return rounded(model.quantiles(scalars(spark, d), SCALARS), "feature")


@query("SELECT doc_id, CAST(len(regexp_extract_all(trim_text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS word_count, CAST(length(trim_text) AS BIGINT) AS char_count FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^" + _SPACES + "+|" + _SPACES + "+$', '', 'g') AS trim_text FROM documents)")
def process_text(spark, d):
    return documents.process(docs(spark, d)).select("doc_id", "word_count", "char_count")


_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


_LINE = _TRIM(r"regexp_replace(x, '[ \t]+', ' ', 'g')")


@query(f"SELECT doc_id, {_TRIM(f"array_to_string(list_transform(string_split({_TRIM("coalesce(text, '')")}, chr(10)), lambda x: {_LINE}), chr(10))")} AS display_text FROM documents")
def display_text(spark, d):
    """Texts with single spaces and no outer ones within lines."""
    return documents.process(docs(spark, d)).select("doc_id", "display_text")


@query("SELECT 'lang' AS \"column\", coalesce(lang, 'None') AS value, count(*) AS rows FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'None'), count(*) FROM documents GROUP BY ALL")
def value_tallies(spark, d):
    return corpus.tallies(docs(spark, d), "lang", "source")


@query(_split_sql("SELECT doc_id, source, 1 - quality AS label FROM documents JOIN labels USING (doc_id)") + " SELECT split, count(DISTINCT source) AS groups, count(*) AS rows, round(count(*) / any_value(all_), 6) AS share, CAST(count_if(label = 0) AS BIGINT) AS human, CAST(count_if(label = 1) AS BIGINT) AS machine FROM dealt, total GROUP BY split")
def split_stats(spark, d):
    rows = corpus.grouped_split(docs(spark, d).join(_labels(spark, d), "doc_id"))
    return rounded(corpus.split_stats(rows), "split")


COLUMNS = response.COLUMNS


def _labels(spark, d) -> DataFrame:
    """doc_id and label: 0 for rows of quality, which stand for human texts, else 1."""
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (1 - F.col("quality")).cast("int").alias("label"))


def _essays(spark, d) -> tuple[DataFrame, dict]:
    """Labelled documents with all 48 measurements of their cleaned texts, staged, and the baseline of label 0."""
    return response.measured(docs(spark, d).join(_labels(spark, d), "doc_id"), ["lang", "source"])


@query()
def feature_table(spark, d):
    """48 measurements of the labelled documents."""
    carried = ("doc_id", "label", "lang", "source", "word_count", "text")
    return rounded(_essays(spark, d)[0].withColumn("word_count", X.n_whitespace_words("text")).select(*carried, *COLUMNS), *carried)


@query(f"{_S} SELECT count(*) AS rows, " + ", ".join(f"CAST({' + '.join(f'count_if({test.format(c=c)})' for c in SCALARS)} AS BIGINT) AS {name}" for name, test in (("nulls", "{c} IS NULL"), ("nans", "isnan({c})"), ("infinite", "isinf({c})"))) + " FROM f")
def integrity_check(spark, d):
    """What the write of five measurements of every document counts in its own pass; a value that is none would make it fail."""
    path = f"{files.shared_dir(spark)}/checked-{uuid.uuid4().hex}"
    got = files.write_checked(scalars(spark, d).select("doc_id", *SCALARS), path, SCALARS)
    files.delete(spark, path)
    return spark.createDataFrame([tuple(got[k] for k in ("rows", "nulls", "nans", "infinite"))], "rows long, nulls long, nans long, infinite long")


@query()
def feature_integrity(spark, d):
    """The same counts over the 48 measurements of the labelled documents."""
    return corpus.integrity(_essays(spark, d)[0], COLUMNS)


#: Prompts by the second part of a group's name, for some groups.
PROMPTS = {"src1": "Write about a place.", "src7": "Write about a person."}


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'human_' ELSE 'ai_' END || substr(md5(text), 1, 8) AS essay_id, CAST(1 - quality AS INTEGER) AS binary_label, 'prompt_' || source AS group_id, CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROMPTS.items()) + " ELSE 'Write an essay.' END AS generation_prompt FROM documents JOIN labels USING (doc_id)")
def corpus_records(spark, d):
    """Labelled documents as records of a corpus: ids of label and text, and the prompt of their group or the default."""
    rows = docs(spark, d).join(_labels(spark, d), "doc_id").select("doc_id", "text", F.when(F.col("label") == 0, "human").otherwise("ai").alias("label"), F.concat(F.lit("prompt_"), "source").alias("group_id"))
    return files.with_prompt(files.as_records(rows), PROMPTS, "Write an essay.").select("doc_id", "essay_id", "binary_label", "group_id", "generation_prompt")


@query()
def feature_registry(spark, d):
    """What each of the 48 measurements is, and its least and greatest value in the labelled documents."""
    ranges = _essays(spark, d)[0].agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.min(c).alias("least"), F.max(c).alias("greatest")) for c in COLUMNS)).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    rows = [(i, c, c.split("_")[0], c in documents.DISTANCES[:3], *registry.FEATURES[c]) for i, c in enumerate(COLUMNS)]
    told = spark.createDataFrame(rows, "position int, feature string, family string, needs_baseline boolean, definition string, unit_range string, interpretation string, limitations string")
    return rounded(told.join(ranges, "feature"), "feature")


@query()
def reference_stats(spark, d):
    """Mean, deviation, median and tails of the 48 measurements over rows of label 0."""
    return rounded(model.quantiles(_essays(spark, d)[0].where("label = 0"), COLUMNS), "feature")


_FAILED = (
    f"{_SCORED}, j AS (SELECT f.*, y.p, 1 - quality AS y, CASE WHEN y.p >= 0.5 THEN 1 ELSE 0 END AS pred FROM f JOIN y USING (doc_id) JOIN labels USING (doc_id)), "
    "bad AS (SELECT * FROM (SELECT 'false_positive' AS kind, * FROM j WHERE y = 0 AND pred = 1 ORDER BY p DESC, doc_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'false_negative' AS kind, * FROM j WHERE y = 1 AND pred = 0 ORDER BY p, doc_id LIMIT 10)), "
    f"h AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 1.0 ELSE stddev_samp({c}) END AS s_{c}' for c in SCALARS)} FROM j WHERE y = 0), "
    "u AS (" + " UNION ALL ".join(f"SELECT kind, doc_id, p, {i} AS ord, '{c}' AS feature, round({c}, 4) AS value, round(m_{c}, 4) AS human_mean, round(({c} - m_{c}) / s_{c}, 2) AS z_score, round(({c} - m_{c}) / s_{c} * {k}, 3) AS model_impact FROM bad, h" for i, (c, (k, _, _)) in enumerate(WEIGHTS.items())) + "), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY kind, doc_id ORDER BY abs(model_impact) DESC, ord) AS rank FROM u)"
)


@query(f"{_FAILED} SELECT kind, doc_id, round(p, 6) AS p, feature, value, human_mean, z_score, model_impact, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 4")
def anomaly_topk(spark, d):
    """Of the surest failures of the fixed linear model the four measurements that drove each, by their distance from rows of label 0."""
    rows = scored(spark, d).join(_labels(spark, d), "doc_id").withColumns({"p": F.col("probability"), "y": F.col("label")}).withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    rows = files.stage(rows.select("doc_id", "text", "p", "y", "pred", *SCALARS))
    found = model.anomalies(model.failures(rows, carry=tuple(SCALARS)), rows.where("y = 0"), WEIGHTS)
    return found.select("kind", "doc_id", F.round("p", 6).alias("p"), F.posexplode("top_features").alias("i", "x")).select("kind", "doc_id", "p", "x.*", (F.col("i") + 1).cast("long").alias("rank"))


@query()
def failure_cases(spark, d):
    """The surest failures on the groups outside of train, by a model fitted on all 48 measurements, each with what drove it."""
    split = files.stage(corpus.grouped_split(_essays(spark, d)[0]).withColumn("y", F.col("label")))
    train = split.where("split = 'train'")
    weights, intercept = model.fit_logistic(train, COLUMNS)
    test = model.score(split.where("split <> 'train'"), weights, intercept).withColumn("p", F.col("probability")).withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    return rounded(model.anomalies(model.failures(test, carry=tuple(COLUMNS)), train.where("y = 0"), weights).drop(*COLUMNS), "kind", "doc_id")


@query()
def mahalanobis(spark, d):
    """The distances of the labelled documents from those of label 0, over 44 measurements."""
    return rounded(_essays(spark, d)[0].select("doc_id", *documents.DISTANCES), "doc_id")


@query(f"{_S}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALARS) + f" FROM f JOIN labels USING (doc_id) WHERE quality = 1) SELECT doc_id, round(sqrt({' + '.join(f'pow(({c} - m_{c}) / s_{c}, 2)' for c in SCALARS)}), 5) AS dist_euclidean, round(CASE WHEN sqrt({' + '.join(f'{c} * {c}' for c in SCALARS)}) < 1e-9 THEN 1.0 ELSE ({' + '.join(f'{c} * m_{c}' for c in SCALARS)}) / sqrt({' + '.join(f'{c} * {c}' for c in SCALARS)}) / sqrt({' + '.join(f'm_{c} * m_{c}' for c in SCALARS)}) END, 5) AS dist_cosine FROM f, m")
def euclid_cosine(spark, d):
    """On five measurements, so that SQL can express it; the baseline is that of label 0."""
    t = scalars(spark, d)
    base = model.fit_baseline(t.join(_labels(spark, d).where("label = 0"), "doc_id"), SCALARS)
    return model.distances(t, SCALARS, base).select("doc_id", F.round("dist_euclidean", 5).alias("dist_euclidean"), F.round("dist_cosine", 5).alias("dist_cosine"))


@query()
def dispersion(spark, d):
    return rounded(model.dispersion(documents.features(documents.paragraph_spans(docs(spark, d).select("doc_id", "text"))), list(documents.BASE)), "doc_id")


@query()
def lr_fit(spark, d):
    weights, _ = model.fit_logistic(_essays(spark, d)[0], COLUMNS)
    return model.weights_table(spark, weights)


@query()
def rf_fit(spark, d):
    """Gini importance of the 48 measurements in a forest fitted on the train groups, and permutation importance on the validation ones."""
    split = files.stage(corpus.grouped_split(_essays(spark, d)[0]))
    m = model.fit_forest(split.where("split = 'train'"), COLUMNS)
    gini = spark.createDataFrame([(c, float(v)) for c, v in zip(COLUMNS, m.featureImportances.toArray())], "feature string, importance double")
    return gini.join(model.permutation_importance(m, split.where("split = 'val'"), COLUMNS), "feature", "left").orderBy(F.desc("importance"), "feature")


@query()
def rf_predict(spark, d):
    t, _ = _essays(spark, d)
    return rounded(model.predict_forest(model.fit_forest(t, COLUMNS), t, COLUMNS).select("doc_id", "label", "p", "pred"), "doc_id", "label")


FAMILIES = {"surface": list(documents.SURFACE), "discourse": list(documents.DISCOURSE), "distance": list(documents.DISTANCES), "surface+discourse": list(documents.BASE), "all": COLUMNS}


@query()
def ablation(spark, d):
    """Each family of measurements by both models, fitted on the train groups and evaluated on the others."""
    split = files.stage(corpus.grouped_split(_essays(spark, d)[0]).withColumn("y", F.col("label")))
    train, test = split.where("split = 'train'"), split.where("split <> 'train'")
    linear_fits = model.fit_many(train, FAMILIES)  # all families in the same scans
    out = None
    for name, columns in FAMILIES.items():
        weights, b = linear_fits[name]
        linear = model.score(test, weights, b).withColumn("p", F.col("probability")).withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))
        for kind, rows in (("logistic", linear), ("forest", model.predict_forest(model.fit_forest(train, columns), test, columns))):
            one = model.evaluate(rows).select(F.lit(name).alias("family"), F.lit(kind).alias("model"), F.lit(len(columns)).alias("n_features"), "*")
            out = one if out is None else out.unionByName(one)
    return rounded(out, "family", "model")


@query()
def features(spark, d):
    """All 44 base measurements of every document."""
    t = documents.features(docs(spark, d).select("doc_id", "text"))
    return rounded(t.select("doc_id", *documents.BASE), "doc_id")


_CLEANSCORED = _CLEAN + ", " + _SCORED.removeprefix("WITH ")


@query(f"{_CLEANSCORED}, q AS (SELECT g.doc_id, status, code, word_count, CASE WHEN code IS NULL THEN p WHEN code = 'INSUFFICIENT_EVIDENCE' THEN 0.5 END AS p FROM gated g JOIN y USING (doc_id)) SELECT doc_id, status, code, word_count, round(p, 6) AS probability, CASE WHEN code IS NOT NULL THEN code " + " ".join(f"WHEN p < {v[0]} THEN '{v[1]}'" for v in L.VERDICTS) + " END AS verdict, CASE WHEN code = 'INSUFFICIENT_EVIDENCE' THEN 'Insufficient Evidence' WHEN code IS NOT NULL THEN NULL " + " ".join(f"WHEN p < {v[0]} THEN '{v[2]}'" for v in L.VERDICTS) + " END AS category, CASE WHEN code = 'INSUFFICIENT_EVIDENCE' THEN '#8b949e' WHEN code IS NOT NULL THEN NULL " + " ".join(f"WHEN p < {v[0]} THEN '{v[3]}'" for v in L.VERDICTS) + " END AS colour, CASE WHEN code = 'INSUFFICIENT_EVIDENCE' THEN 'N/A (Short Text)' WHEN code IS NOT NULL THEN NULL WHEN p < 0.15 AND word_count >= 120 THEN 'High' WHEN p < 0.35 THEN 'Moderate' WHEN p < 0.65 THEN 'Low' WHEN p > 0.9 AND word_count >= 120 THEN 'High' ELSE 'Moderate' END AS confidence FROM q")
def analysis(spark, d):
    """The flagship: gate, measurements of the cleaned text, score, verdict and confidence of every document, in one projection."""
    gated = documents.gate(docs(spark, d)).withColumn("text", F.col("cleaned"))
    out = documents.verdict(documents.undecided(model.score(documents.surface(gated), WEIGHTS, INTERCEPT)))
    return out.select("doc_id", "status", "code", "word_count", F.round("probability", 6).alias("probability"), "verdict", "category", "colour", "confidence")


@query()
def analysis_response(spark, d):
    """The whole response of every document by a model fitted on all 48 measurements of the labelled ones."""
    return response.analyse(docs(spark, d), response.train(*_essays(spark, d)))


@query()
def exported_response(spark, d):
    """The same from an artifact that was trained and written in one call and read again: status and score of every document."""
    path = f"{files.shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    response.train_and_export(docs(spark, d).join(_labels(spark, d), "doc_id"), path)
    out = response.analyse(docs(spark, d), files.load_artifact(spark, path))
    return out.select("doc_id", "status", "model_version", F.col("assessment.verdict_code").alias("verdict"), F.col("assessment.calibrated_ai_probability").alias("probability"), F.size("highlighted_spans").cast("long").alias("spans"))


@query()
def top_drivers(spark, d):
    """What a reader sees first: three drivers towards a machine, two towards a person, by readable names, and the first flagged span."""
    out = analysis_response(spark, d)
    shown = lambda c, n: F.transform(F.slice(c, 1, n), lambda x: F.initcap(F.regexp_replace(F.regexp_replace(x["feature"], "^(surface|discourse|dist)_", ""), "_", " ")))
    flagged = F.get(F.filter("highlighted_spans", lambda s: s["overall_severity"].isin("high", "medium")), F.lit(0))
    return out.select("doc_id", F.array_join(shown(F.col("evidence.top_ai_evidence"), 3), ", ").alias("machine"), F.array_join(shown(F.col("evidence.top_human_evidence"), 2), ", ").alias("human"), flagged["span_id"].alias("first_flagged"))
