"""Operators on documents: cleaning, spans, measurements, evidence. All keep to one row's data until a join is asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counted
from ..functions import lexicon as L
from ..functions import text as X

SENTENCE = r"(?sU).+?(?:[.!?][\"'”’]?\s+|\z)"
SENTENCE_END = r"(?sU)[.!?][\"'”’]?\s+$"


def clean(df: DataFrame, headers: bool = True, compose: bool = True) -> DataFrame:
    """cleaned text and its audit, for every row of a table with text. Null and empty texts are empty."""
    t = F.coalesce("text", F.lit(""))
    t, before, after = X.stripped(X.end_of_lines(X.nfkc(t) if compose else t))
    t = X.without_header(t) if headers else t
    df = df.withColumns({"_p": X.paragraphs(t), "removed_prefixes": before, "removed_suffixes": after})
    cleaned = F.array_join("_p", "\n\n")
    return df.withColumns({"cleaned": cleaned, "is_empty": cleaned == "", "raw_char_count": F.length(F.coalesce("text", F.lit(""))).cast("long"), "cleaned_char_count": F.length(cleaned).cast("long"), "paragraph_count": F.size("_p").cast("long")}).drop("_p")


def process(df: DataFrame, cleaner: bool = False) -> DataFrame:
    """analysis text (cleaned, or only trimmed), display text (single spaces within lines), word_count and char_count."""
    t = F.coalesce("text", F.lit(""))
    df = clean(df).withColumn("analysis_text", F.col("cleaned")) if cleaner else df.withColumn("analysis_text", X.strip(t))
    return df.withColumns({"display_text": X.inline_spaces(F.col("analysis_text")), "word_count": F.regexp_count("analysis_text", F.lit(X.WORD)).cast("long"), "char_count": F.length("analysis_text").cast("long")})


def pieces(text: Column, pattern: str) -> Column:
    """Contiguous pieces with their offsets: array of struct(start, piece)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return X.let(found, lambda p: F.zip_with(X.starts(F.transform(p, F.length)), p, lambda at, x: F.struct(at.alias("start"), x.alias("piece"))))


PARAGRAPH = r"[^\n]+(?:\n[^\n]+)*"


def paragraph_spans(df: DataFrame) -> DataFrame:
    """doc_id, paragraph_idx, start_char, end_char, text: runs of lines that aren't empty, in the raw text."""
    runs = F.filter(pieces(F.coalesce("text", F.lit("")), r"[^\n]+(?:\n[^\n]+)*|\n+"), lambda s: ~s["piece"].startswith("\n"))
    rows = df.select("doc_id", F.posexplode(runs).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("paragraph_idx"), F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.piece")).alias("end_char"), F.col("s.piece").alias("text"))


def sentences(text: Column, of_paragraph: Callable[[Column], Column] | None = None) -> Column:
    """Array of struct(paragraph_idx, start, text, context): context is what of_paragraph gives for the sentence's paragraph."""
    runs = F.filter(pieces(text, r"[^\n]+(?:\n[^\n]+)*|\n+"), lambda s: ~s["piece"].startswith("\n"))
    of_paragraph = of_paragraph or (lambda p: F.lit(None))

    def of(p: Column, i: Column) -> Column:
        trimmed = lambda x: F.when(x.rlike(SENTENCE_END), F.regexp_replace(x, r"(?U)\s+$", "")).otherwise(x)
        own = lambda c: F.transform(pieces(p["piece"], SENTENCE), lambda s: F.struct(i.cast("long").alias("paragraph_idx"), (p["start"] + s["start"]).alias("start"), trimmed(s["piece"]).alias("text"), c.alias("context")))
        return F.filter(X.let(of_paragraph(p["piece"]), own), lambda s: X.strip(s["text"]) != "")

    return F.flatten(F.transform(runs, of))


def sentence_spans(df: DataFrame) -> DataFrame:
    """doc_id, sentence_idx (over the document), paragraph_idx, start_char, end_char, text. One row a sentence."""
    rows = df.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("sentence_idx"), "s.paragraph_idx", F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.text")).alias("end_char"), "s.text")


#: Halvings that find a place among 2^31 spans.
HALVINGS = 31


def sentence_at(df: DataFrame, offsets: DataFrame, most: int = 4096) -> DataFrame:
    """doc_id, offset, sentence_idx of the sentence with start <= offset < end, else null; a row for each row of offsets.

    The offsets of a document meet its text as arrays of at most ``most`` places each, so that neither a document with
    many offsets nor one with many sentences is exploded: each offset is found by halving the sorted spans in the row.
    """
    asked = offsets.where("doc_id is not null").groupBy("doc_id", F.floor(F.col("offset") / most).alias("_part")).agg(F.collect_set("offset").alias("_asked"))
    spans = F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(s["start"].cast("long").alias("start"), (s["start"] + F.length(s["text"])).cast("long").alias("end")))

    def found(z: Column, x: Column) -> Column:
        """The last span that starts at x or before, by halving; null if x isn't in it."""
        step = lambda s, _: F.when(s["lo"] < s["hi"], X.let(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int"), lambda m: F.when(F.get(z, m)["start"] <= x, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi"))))).otherwise(s)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(-1).alias("lo"), (F.size(z) - 1).alias("hi")), step, lambda s: s["lo"])
        return X.let(place, lambda i: F.when((i >= 0) & (x < F.get(z, i)["end"]), i.cast("long")))

    met = asked.join(df.select("doc_id", "text"), "doc_id").select("doc_id", "_asked", spans.alias("_z"))
    hits = met.select("doc_id", F.explode(F.transform("_asked", lambda x: F.struct(x.alias("offset"), found(F.col("_z"), x).alias("sentence_idx")))).alias("h")).select("doc_id", "h.*")
    return offsets.join(hits, ["doc_id", "offset"], "left")


def cut(df: DataFrame) -> DataFrame:
    """_low (lower-case text), _w (tokens) and _v (words) of each row: cut once for all families of measurements."""
    t = F.coalesce("text", F.lit(""))
    df = df.withColumns({"_low": F.lower(t), "_v": X.words(t)})
    return df.withColumn("_w", F.regexp_extract_all("_low", F.lit(X.WORD_APOSTROPHE), F.lit(0)))


CUT = ("_low", "_w", "_v")


def surface(df: DataFrame) -> DataFrame:
    """Entropies, richness, stopwords, tags and punctuation of each row: a projection, nothing is shuffled."""
    return _surface(cut(df)).drop(*CUT)


def _surface(df: DataFrame) -> DataFrame:
    df = df.withColumn("_s", counted.surface(F.coalesce("text", F.lit("")), F.col("_w"), F.col("_v")))
    return df.withColumns({f"surface_{k}": F.col("_s")[k] for k in counted.SURFACE} | {"surface_passive_ratio": F.lit(0.0)}).drop("_s")


def rhythm(df: DataFrame) -> DataFrame:
    """Sentence and paragraph lengths (in words) of each row: mean, median, spread and changes. A projection."""
    return _rhythm(cut(df)).drop(*CUT)


def _rhythm(df: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    runs = F.filter(F.regexp_extract_all(t, F.lit(r"[^\n]+(?:\n[^\n]+)*|\n+"), F.lit(0)), lambda s: ~s.startswith("\n"))
    length = lambda s: F.regexp_count(s, F.lit(X.WORD)).cast("double")
    found = F.flatten(F.transform("_p", lambda p: F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0))))
    df = df.withColumn("_p", runs).withColumns({"_pl": F.transform("_p", length), "_sl": F.transform(F.filter(found, lambda s: s.rlike(r"(?U)\S")), length)})
    df = df.withColumn("_sl", F.when(F.size("_sl") > 0, F.col("_sl")).otherwise(F.array(F.size("_w").cast("double"))))
    df = df.withColumn("_s", counted.rhythm("_sl", "_pl"))
    return df.withColumns({f"surface_{k}": F.when(F.size("_w") > 0, F.col("_s")[k]).otherwise(0.0) for k in counted.RHYTHM}).drop("_p", "_pl", "_sl", "_s")


def compression(df: DataFrame) -> DataFrame:
    return _compression(cut(df)).drop(*CUT)


def _compression(df: DataFrame) -> DataFrame:
    return df.withColumn("surface_compression_ratio", F.when(F.size("_w") > 0, X.deflated("text") / F.greatest(F.octet_length("text"), F.lit(1))).otherwise(0.0))


def discourse(df: DataFrame) -> DataFrame:
    """Agency, reflection, stock phrases, connectives and vocabulary of each row, per 100 words. A projection."""
    return _discourse(cut(df)).drop(*CUT)


def _discourse(df: DataFrame) -> DataFrame:
    low, n = F.col("_low"), F.greatest(F.size("_w"), F.lit(1))
    # Starts of matches: gaps and matches take turns, so that sums of what stands before each second piece are the starts.
    def places(p: str) -> Column:
        gaps, hits = F.split(low, f"(?dU){p}", -1), F.regexp_extract_all(low, F.lit(f"(?dU){p}"), F.lit(0))
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
        found = X.let(lengths, lambda z: F.zip_with(X.starts(F.transform(z, lambda x: x["g"] + x["h"])), z, lambda at, x: at + x["g"]))
        return F.when(X.holds(low, p), found).otherwise(F.array().cast("array<bigint>"))

    df = df.withColumn("_r", F.transform(F.concat(*map(places, L.REFLECTION)), lambda x: x / F.greatest(F.length(low), F.lit(1))))
    r, found = F.col("_r"), F.size("_r")
    part = lambda a, b: F.when(found > 0, F.size(F.filter(r, lambda x: (x >= a) & (x < b))) / F.greatest(found, F.lit(1))).otherwise(0.0)
    df = df.withColumn("_s", counted.vocabulary("_w", "_v"))
    action, passive, abstract, concrete = (F.col("_s")[k] / n * 100.0 for k in counted.VOCABULARY)
    out = {
        "agency_action_density": action, "agency_passive_density": passive, "agency_ratio": action / F.greatest(action + passive, F.lit(1e-5)), "reflection_density": found / n * 100.0,
        "reflection_intro_ratio": part(0.0, 0.33), "reflection_body_ratio": part(0.33, 0.67), "reflection_conclusion_ratio": part(0.67, 2.0), "reflection_mean_pos": F.when(found > 0, X.total(r) / F.greatest(found, F.lit(1))).otherwise(0.5),
        "formulaic_moral_density": X.matches_in(low, L.FORMULAIC) / n * 100.0, "causal_density": X.matches_in(low, L.CAUSAL) / n * 100.0, "temporal_density": X.matches_in(low, L.TEMPORAL) / n * 100.0,
        "abstract_vocab_density": abstract, "concrete_density": concrete, "concrete_abstract_ratio": concrete / F.greatest(concrete + abstract, F.lit(1e-5)),
    }
    return df.withColumns({f"discourse_{k}": c for k, c in out.items()}).drop("_r", "_s")


def features(df: DataFrame) -> DataFrame:
    """All 44 base measurements of each row."""
    return _discourse(_compression(_rhythm(_surface(cut(df))))).drop(*CUT)


#: The 44 base measurements in order, by family.
SURFACE = tuple(f"surface_{n}" for n in "char_entropy word_entropy bigram_entropy compression_ratio sent_len_mean sent_len_median sent_len_std sent_len_cv sent_delta_variance sent_delta_mean_abs ttr root_ttr hapax_ratio stopword_ratio top10_concentration pos_noun_ratio pos_verb_ratio pos_adj_ratio pos_adv_ratio pos_pronoun_ratio pos_prep_ratio passive_ratio comma_rate semicolon_rate colon_rate emdash_rate quote_rate parentheses_rate para_len_mean para_len_std".split())
DISCOURSE = tuple(f"discourse_{n}" for n in "agency_action_density agency_passive_density agency_ratio reflection_density reflection_intro_ratio reflection_body_ratio reflection_conclusion_ratio reflection_mean_pos formulaic_moral_density causal_density temporal_density abstract_vocab_density concrete_density concrete_abstract_ratio".split())
BASE = SURFACE + DISCOURSE
DISTANCES = ("dist_human_euclidean", "dist_human_mahalanobis", "dist_human_cosine", "dist_structural_dispersion")


def passive_ratio(tags: Column, sentences: Column) -> Column:
    """Forms of to be (BE) followed by a participle (VBN), at once or after adverbs (RB) one place on, for each sentence.

    The rule tagger gives neither tag, so with its tags this is 0.
    """
    at = lambda i: F.get(tags, i)
    hits = F.filter(F.transform(tags, lambda t, i: (t == "BE") & (F.coalesce(at(i + 1) == "VBN", F.lit(False)) | (F.coalesce(at(i + 1) == "RB", F.lit(False)) & F.coalesce(at(i + 2) == "VBN", F.lit(False))))), lambda x: x)
    return F.size(hits) / F.greatest(sentences, F.lit(1))


ITEM = "sentence_idx int, paragraph_idx int, start_char int, end_char int, text string, feature_name string, feature_display_name string, observed_value double, reference_mean double, reference_std double, deviation_z double, direction string, evidence_strength string, explanation string"


def _phrase(pattern: str) -> str:
    """A pattern as readers see it."""
    for sign in (r"\b", "(?:", ")?", ")"):
        pattern = pattern.replace(sign, "")
    return pattern


def evidence_array(text: Column, mean: float = 1.5, std: float = 1.2) -> Column:
    """Array of one struct for each sentence: span, severity, score, and the items that the rules give. Nothing leaves the row."""
    hits = lambda w, values: F.filter(w, lambda x: x.isin(values))
    listed = lambda words: F.array_join(F.transform(words, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    known = lambda words: F.array_sort(F.array_distinct(words))
    lit, percent = F.lit, lambda c: F.format_string("%.1f", c)

    def of_paragraph(p: Column) -> Column:
        return X.let(X.tokens(p), lambda w: F.struct(hits(w, L.ABSTRACT).alias("a"), F.greatest(F.size(w), lit(1)).alias("n")))

    def measured(s: Column, w: Column) -> Column:
        low = F.lower(s["text"])
        phrase = reduce(lambda c, p: c.when(X.holds(low, p), _phrase(p)), L.FORMULAIC[1:], F.when(X.holds(low, L.FORMULAIC[0]), _phrase(L.FORMULAIC[0])))
        return F.struct(F.greatest(F.size(w), lit(1)).alias("n"), hits(w, L.ABSTRACT).alias("a"), hits(w, L.CONCRETE).alias("k"), F.size(hits(w, L.PASSIVE_STATE_VERBS)).alias("passive"), F.size(hits(w, L.ACTION_VERBS)).alias("action"), F.exists(w, lambda x: x.isin(L.FIRST_PERSON)).alias("person"), phrase.alias("phrase"))

    def judged(s: Column, i: Column, m: Column) -> Column:
        density, p_density = F.size(m["a"]) / m["n"] * 100, F.size(s["context"]["a"]) / s["context"]["n"] * 100
        z = (density - mean) / max(0.5, std)
        a_on, b_on = F.size(m["a"]) >= 1, m["phrase"].isNotNull()
        a_strong = (F.size(m["a"]) >= 2) | (z >= 2.5)
        c_on = m["person"] & (m["passive"] > 0) & (m["action"] == 0)
        h_on = ~c_on & (F.size(m["k"]) >= 1) & ~a_on & ~b_on
        first = F.when(a_on, F.when(a_strong, 1.5).otherwise(1.0)).otherwise(0.0) + F.when(b_on, 1.5).otherwise(0.0) + F.when(c_on, 0.6).otherwise(0.0)
        d_on = (first < 1.0) & (p_density >= 3.5) & (F.size(s["context"]["a"]) >= 2)
        end = s["start"] + F.length(s["text"])

        def item(on, name, shown, seen, ref, dev, away, direction, strength, why):
            own = F.struct(i.cast("int"), s["paragraph_idx"].cast("int"), s["start"].cast("int"), end.cast("int"), s["text"], lit(name), lit(shown), F.round(seen, 2), lit(round(ref, 2)), lit(round(dev, 2)), F.round(away, 2), lit(direction), strength, why)
            return F.when(on, own.cast(f"struct<{', '.join(': '.join(f.split(' ')) for f in ITEM.split(', '))}>"))

        items = F.array_compact(F.array(
            item(a_on, "discourse_abstract_vocab_density", "Abstract words", density, mean, std, F.greatest(lit(0.0), z), "AI-skewed", F.when(a_strong, "Strong").otherwise("Moderate"), F.concat(percent(density), lit(f"% of the words are abstract, against {mean:.1f}% in human texts: "), listed(known(m["a"])), lit("."))),
            item(b_on, "discourse_formulaic_moral_density", "Stock phrase", lit(1.0), 0.1, 0.3, lit(3.0), "AI-skewed", F.when(a_on, "Strong").otherwise("Moderate"), F.concat(lit("Holds a stock phrase: '"), m["phrase"], lit("'."))),
            item(c_on, "discourse_agency_passive_density", "Passive narrator", m["passive"].cast("double"), 0.3, 0.5, lit(1.4), "AI-skewed", lit("Mild"), lit("The narrator feels or receives, and does nothing.")),
            item(h_on, "discourse_concrete_sensory_density", "Concrete words", F.size(m["k"]) / m["n"] * 100, 2.8, 1.5, lit(0.0), "Human-skewed", lit("Moderate"), F.concat(lit("Grounded in things: "), listed(known(m["k"])), lit("."))),
            item(d_on, "discourse_paragraph_abstraction", "Abstract paragraph", p_density, 1.5, 1.2, (p_density - 1.5) / 1.2, "AI-skewed", lit("Mild"), F.concat(lit("Paragraph "), (s["paragraph_idx"] + 1).cast("string"), lit(" holds "), percent(p_density), lit("% abstract words: "), listed(F.slice(known(s["context"]["a"]), 1, 3)), lit("."))),
        ))
        score = F.round(first + F.when(d_on, 0.8).otherwise(0.0), 2)

        def span(x: Column) -> Column:
            ai = F.filter(x, lambda e: e["direction"] == "AI-skewed")
            severity = F.when(F.exists(ai, lambda e: e["evidence_strength"] == "Strong") | (score >= 1.8), "high").when((F.size(ai) >= 1) | (score >= 0.8), "medium").when(F.size(x) > F.size(ai), "human_grounded").otherwise("neutral")
            return F.struct(F.concat(lit("span_"), i.cast("string")).alias("span_id"), i.cast("long").alias("sentence_idx"), s["paragraph_idx"].alias("paragraph_idx"), s["start"].alias("start_char"), end.alias("end_char"), s["text"].alias("text"), severity.alias("overall_severity"), score.alias("ai_evidence_score"), F.size(ai).cast("long").alias("ai_evidence_count"), x.alias("items"))

        return X.let(items, span)

    return F.transform(sentences(text, of_paragraph), lambda s, i: X.let(X.let(X.tokens(s["text"]), lambda w: measured(s, w)), lambda m: judged(s, i, m)))


def evidence(df: DataFrame, mean: float = 1.5, std: float = 1.2) -> DataFrame:
    """One row a sentence: span, severity, score, and the items that the rules give."""
    return df.select("doc_id", F.explode(evidence_array(F.coalesce("text", F.lit("")), mean, std)).alias("s")).select("doc_id", "s.*")


def gate(df: DataFrame) -> DataFrame:
    """word_count of the cleaned text, and status and code of texts too short to judge (code null: long enough)."""
    out = clean(df).withColumn("word_count", X.n_whitespace_words("cleaned"))
    empty = X.strip(F.coalesce("text", F.lit(""))) == ""
    n = F.col("word_count")
    return out.withColumns({"status": F.when(empty, "ERROR").when(n < 20, "INSUFFICIENT_LENGTH").otherwise("SUCCESS"), "code": F.when(empty, "EMPTY_INPUT").when(n < 20, "INSUFFICIENT_LENGTH").when(n < 75, "INSUFFICIENT_EVIDENCE")})


def verdict(df: DataFrame) -> DataFrame:
    """verdict, category, colour and confidence of rows with probability and word_count; of rows with a code that says why not, that."""
    p, n = F.col("probability"), F.col("word_count")
    chain = lambda k: reduce(lambda c, v: c.when(p < v[0], v[k]), L.VERDICTS[1:], F.when(p < L.VERDICTS[0][0], L.VERDICTS[0][k]))
    sure = F.when(n >= 120, "High").otherwise("Moderate")
    out = {"verdict": chain(1), "category": chain(2), "colour": chain(3), "confidence": F.when(p < 0.15, sure).when(p < 0.35, "Moderate").when(p < 0.65, "Low").when(p > 0.9, sure).otherwise("Moderate")}
    if "code" in df.columns:
        none = {"verdict": F.col("code"), **{k: F.when(F.col("code") == "INSUFFICIENT_EVIDENCE", v) for k, v in zip(("category", "colour", "confidence"), L.UNDECIDED)}}
        out = {k: F.when(F.col("code").isNull(), c).otherwise(none[k]) for k, c in out.items()}
    return df.withColumns(out)


def undecided(df: DataFrame) -> DataFrame:
    """Texts too short to judge have no score: logit 0 and probability 0.5, and neither where nothing was measured."""
    short, code = F.col("code") == "INSUFFICIENT_EVIDENCE", F.col("code")
    return df.withColumns({"logit": F.when(code.isNull(), F.col("logit")).when(short, 0.0), "probability": F.when(code.isNull(), F.col("probability")).when(short, 0.5)})


#: What a reader is told, by verdict; the last has a second form for texts without a flagged sentence.
SUMMARIES = {
    "LIKELY_HUMAN": "Rhythm, agency and concrete detail are those of human texts.",
    "UNCERTAIN": "Signs of both kinds are in balance; the author can't be told.",
    "LIKELY_AI_ASSISTED": "Human matter in a form that looks revised by a machine: even sentences, abstract words.",
    "LIKELY_AI_GENERATED": "Several families of measurements are far from human texts; sentences with marks of a machine: %d.",
    "INSUFFICIENT_EVIDENCE": "The text is too short to judge; sentence evidence is given all the same.",
}
UNFLAGGED = "The measurements of the whole text are far from human ones, though no single sentence is."
DISCLAIMERS = {
    "probability": "Statistics are no proof of authorship; a person should read the whole.",
    "fairness": "Nothing about the writer is inferred; unusual styles, a second language among them, can look odd.",
    "method": "Scores come from fixed measurements and a linear model; no language model was asked.",
}


def summary(verdict: Column, flagged: Column) -> Column:
    last = F.when(flagged > 0, F.format_string(SUMMARIES["LIKELY_AI_GENERATED"], flagged)).otherwise(UNFLAGGED)
    out = F.when(verdict == "LIKELY_AI_GENERATED", last)
    for code, said in SUMMARIES.items():
        if code != "LIKELY_AI_GENERATED":
            out = out.when(verdict == code, said)
    return out
