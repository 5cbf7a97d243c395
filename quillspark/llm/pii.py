"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

E-mail addresses, telephone numbers, card numbers, IPv4 addresses, social security numbers and dates are found and
validated (check digit, octets, number ranges, calendar). Card numbers are sought first, among all runs of whole digit
groups, and only those with a right check digit are taken, so that digits beside another value don't hide it; the other
kinds are found in one pass over the rest, by patterns that only match what is valid. Dates are yyyy-mm-dd, dd-mm-yyyy
or, where the second number is over 12, mm-dd-yyyy, with ``-``, ``/`` or ``.``. A value becomes an array of symbols with
a modulus each: letters as many as their script's run of them has, digits 10, octets 256, days of two centuries 17 x 4297. Eight keyed Feistel rounds move one half of
the array by a key stream drawn from SHA-256 over key, kind, round and the other half, each symbol inside its modulus,
which is a permutation of all values of that shape. The pseudonym has the same format, and equal values give equal
pseudonyms in every document. Mail domains stay, as do a telephone's country code and every value that is not valid.
Telephone numbers are valid by length and grouping (3-3-4 digits, or 8 to 15 after a +): plans differ by country.
"""

from __future__ import annotations

import hashlib
import os
import re
import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, rows_of

#: Even, so that the halves end in their places.
ROUNDS = 8
#: Fixed patterns, in Java's syntax. A value must not touch a letter, digit or joining sign on its left.
EMAIL = r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@[\p{L}0-9](?:[\p{L}\p{M}0-9.-]*[\p{L}\p{M}0-9])?\.\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
IP = rf"(?<![\p{{L}}0-9.-]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}0-9-]|\.\d)"
SSN = r"(?<![\p{L}0-9.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}0-9-])"
SHAPES = "|".join(rf"(?:19|20)\d\d{s}\d\d{s}\d\d|\d{{1,2}}{s}\d{{1,2}}{s}(?:19|20)\d\d" for s in ("-", "/", "[.]"))
DATE = rf"(?<![\p{{L}}0-9./-])(?:{SHAPES})(?![\p{{L}}0-9/-]|\.\d)"
#: Digit groups joined by single spaces or hyphens, with 13 digits at least: where card numbers may stand.
CHAIN = r"(?<![\p{L}0-9.+-])(?=\d(?:[ -]?\d){12})\d++(?:-\d++)*+(?: \d++(?:-\d++)*+)*(?![\p{L}0-9-]|\.\d|[\p{L}0-9._%+-]*+@)"
CARD = r"(?<![\p{L}0-9.+-])\d(?:[ -]?\d){12,18}(?![\p{L}0-9-])"
PHONE = r"(?<![\p{L}0-9.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?![\p{L}0-9-])"
#: By country code, in any grouping: 8 to 15 digits.
ABROAD = r"(?<![\p{L}0-9.])\+(?=[1-9])(?:\d(?:[ .-]|[ .-]?\(|\)[ .-]?)?){7,14}\d(?![\p{L}0-9-])"
#: Stands around card numbers while the other kinds are sought: a code point kept for internal use. A text that has it gets no marks and is searched for CARD like the other kinds.
MARK = "\ufdd0"
KINDS = {"marked": f"{MARK}[0-9 -]+{MARK}", "email": EMAIL, "ip": IP, "ssn": SSN, "date": DATE, "phone": PHONE, "abroad": ABROAD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
PLAIN = "|".join(f"(?:{p})" for k, p in {**KINDS, "card": CARD}.items() if k != "marked")
#: Country codes of telephone numbers: those of one and two digits; all others have three.
COUNTRY = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Runs of code points within which a letter or digit of a mail address is permuted: first and last. A letter of none of
#: them moves among the sixteen code points that share all but the last hexadecimal digit.
LETTERS = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F),
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
FIRST_DAY, YEARS, DAYS = "1900-01-01", (17, 4297), 17 * 4297
#: Steps within which every date whose day is over 12 comes to another such date.
WALK = 64


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel(v: str, m: str, kind: str, key: str) -> str:
    """SQL of the permuted array: names of arrays of int of one length (values and moduli) and of the kind.

    The halves change places after each round, so that one expression moves both; after an even number they are back.
    A single symbol has no other half: it goes to its place in the order of keyed digests of all symbols.
    """
    half = f"cast(ceil(size({v}) / 2.0D) as int)"
    stream = f"sha2(concat_ws('|', '{key}', {kind}, cast(r as string), array_join(transform(s.r, o -> cast(o as string)), ',')), 256)"
    moved = _let(stream, "h", "transform(s.l, (x, i) -> cast((x + cast(conv(substr(h, 1 + 4 * (i % 16), 4), 16, 10) as int)) % s.m[i] as int))")
    start = f"named_struct('l', slice({v}, 1, {half}), 'r', slice({v}, {half} + 1, size({v})), 'm', slice({m}, 1, {half}), 'n', slice({m}, {half} + 1, size({m})))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> named_struct('l', s.r, 'r', {moved}, 'm', s.n, 'n', s.m), s -> concat(s.l, s.r))"
    digests = f"array_sort(transform(sequence(0, {m}[0] - 1), i -> named_struct('h', sha2(concat_ws('|', '{key}', {kind}, 'one', cast({m}[0] as string), cast(i as string)), 256), 'i', i)))"
    return f"if(size({v}) = 1, array(cast(array_position(transform({digests}, d -> d.i), {v}[0]) as int) - 1), {rounds})"


def _of_class(x: str, first: str, last: str, else_: str) -> str:
    """SQL that picks what to give of the run of code points that holds the character x; n is its code point."""
    runs = " ".join(f"when n between {a} and {b} then {first.format(a=a, b=b)}" for a, b in LETTERS)
    return _let(f"ascii({x})", "n", f"case {runs} when {x} rlike '[\\\\p{{L}}]' then {last} else {else_} end")


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum of an array of digits whose last one counts once."""
    return f"aggregate(transform(reverse({digits}), (d, i) -> if(i % 2 = 1, if(2 * d > 9, 2 * d - 9, 2 * d), d)), 0, (a, d) -> a + d)"


def _digits(text: str) -> str:
    return f"transform(filter(split({text}, ''), x -> x between '0' and '9'), x -> cast(x as int))"


def _parsed(x: str) -> str:
    """SQL of struct(kind, v, m, parts) of a matched value; null where it isn't valid.

    v and m are the symbols to permute and their moduli; parts is what the value is put together from again.
    """
    octets = f"transform(split({x}, '[.]'), o -> cast(o as int))"
    area = f"cast(substr({x}, 1, 3) as int)"
    # Areas 1-665 and 667-899 are numbered 0-897.
    ssn = f"if({area} between 1 and 899 and {area} <> 666, array({area} - if({area} > 666, 2, 1), cast(substr({x}, 5, 2) as int) - 1, cast(substr({x}, 8, 4) as int) - 1), null)"
    # Year first, else day first; month first where only that is a date.
    iso = "case when length(p[0]) = 4 then concat_ws('-', p) when int(p[1]) > 12 then concat_ws('-', p[2], lpad(p[0], 2, '0'), lpad(p[1], 2, '0')) else concat_ws('-', p[2], lpad(p[1], 2, '0'), lpad(p[0], 2, '0')) end"
    day = _let(f"split({x}, '[-/.]')", "p", f"datediff(try_cast({iso} as date), date'{FIRST_DAY}')")
    days = _let(day, "n", f"if(n between 0 and {DAYS - 1}, array(cast(floor(n / {YEARS[1]}) as int), cast(n % {YEARS[1]} as int)), null)")
    digits = _digits(x)
    card = _let(digits, "d", f"if({_luhn('d')} % 10 = 0, slice(d, 1, size(d) - 1), null)")
    # All but the country code.
    head = f"regexp_extract({x}, '^([+]({COUNTRY})[ .-]?)?', 0)"
    number = f"substr({x}, length({head}) + 1)"
    local = f"split(substring_index({x}, '@', 1), '')"
    code = f"transform(c, x -> {_of_class('x', 'n - {a}', 'n % 16', '0')})"
    wide = f"transform(c, x -> {_of_class('x', '{b} - {a} + 1', '16', '1')})"

    def row(kind: str, v: str, m: str, parts: str) -> str:
        return _let(v, "v", f"if(v is null, null, named_struct('kind', '{kind}', 'v', v, 'm', {m}, 'parts', {parts}))")

    tens = "transform(v, o -> 10)"
    return f"""case
        when {x} like '%@%' then {_let(local, "c", row("email", code, wide, f"concat(c, array(substr({x}, instr({x}, '@'))))"))}
        when {x} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then {row("ip", f"if(array_max({octets}) < 256, {octets}, null)", "array(256, 256, 256, 256)", "cast(array() as array<string>)")}
        when {x} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {row("ssn", f"if(array_min({ssn}) < 0, null, {ssn})", "array(898, 99, 9999)", "cast(array() as array<string>)")}
        when {x} rlike '^([0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}})$' then {row("date", days, f"array{YEARS}", f"concat(split({x}, '[-/.]'), array(regexp_extract({x}, '[-/.]', 0)))")}
        when {x} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' then {row("card", card, tens, f"split({x}, '')")}
        else {row("phone", _digits(number), tens, f"concat(array({head}), split({number}, ''))")} end"""


def _written(v: str, kind: str, parts: str) -> str:
    """SQL of the value that permuted symbols spell, in the format of the one they come from."""
    new = f"date_add(date'{FIRST_DAY}', {v}[0] * {YEARS[1]} + {v}[1])"
    form = f"date_format({new}, case when length({parts}[0]) = 4 then 'yyyy-MM-dd' when int({parts}[1]) > 12 then 'MM-dd-yyyy' else 'dd-MM-yyyy' end)"
    form = f"replace(if(length({parts}[0]) = 1 or length({parts}[1]) = 1, regexp_replace({form}, '(^|-)0', '$1'), {form}), '-', {parts}[3])"
    sign = _let(_of_class("x", f"{{a}} + {v}[i]", f"n - n % 16 + {v}[i]", "n"), "u", "if(u < 128, char(u), decode(unhex(lpad(hex(u), 8, '0')), 'UTF-32'))")
    email = f"concat(array_join(transform(slice({parts}, 1, size({v})), (x, i) -> {sign}), ''), element_at({parts}, -1))"
    check = f"concat({v}, array((10 - {_luhn(f'concat({v}, array(0))')} % 10) % 10))"
    # Digits over those of the format, in order.
    filled = _let(f"if({kind} = 'card', {check}, {v})", "d", f"aggregate({parts}, named_struct('o', cast(array() as array<string>), 'n', 0), (a, x) -> if(x between '0' and '9' and length(x) = 1, named_struct('o', concat(a.o, array(cast(d[a.n] as string))), 'n', a.n + 1), named_struct('o', concat(a.o, array(x)), 'n', a.n)), a -> array_join(a.o, ''))")
    return f"""case {kind} when 'email' then {email} when 'ip' then array_join({v}, '.')
        when 'ssn' then concat(lpad(cast({v}[0] + if({v}[0] >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast({v}[1] + 1 as string), 2, '0'), '-', lpad(cast({v}[2] + 1 as string), 4, '0'))
        when 'date' then {form} else {filled} end"""


def pseudonym(value: str, key: str) -> str:
    """SQL of struct(kind, new) of a matched value; both are null where it isn't valid.

    A date written month first is permuted again until its day is over 12 as well, so that no two dates get one pseudonym.
    """
    again = f"p.kind = 'date' and length(p.parts[0]) < 3 and int(p.parts[1]) > 12 and day(date_add(date'{FIRST_DAY}', v[0] * {YEARS[1]} + v[1])) < 13"
    turn = _let(feistel("w.v", "p.m", "p.kind", key), "v", f"named_struct('v', v, 'more', {again})")
    walk = f"aggregate(sequence(1, if(p.kind = 'date', {WALK}, 1)), named_struct('v', p.v, 'more', true), (w, k) -> if(w.more, {turn}, w), w -> w.v)"
    new = _let(walk, "v", _written("v", "p.kind", "p.parts"))
    return _let(value, "text_", _let(_parsed("text_"), "p", f"named_struct('kind', p.kind, 'new', if(p is null, null, {new}))"))


def _marked(chain: str) -> str:
    """SQL of a chain with marks around its card numbers: from the left, the longest run of whole groups that is valid."""
    digits = "replace(array_join(slice(g, i, j - i + 1), ''), '-', '')"
    ends = f"filter(sequence(i, least(i + 18, size(g))), j -> if(length({digits}) between 13 and 19, {_luhn(_digits(digits))} % 10 = 0, false))"
    card = f"concat('{MARK}', array_join(slice(g, i, e - i + 1), ' '), '{MARK}')"
    step = _let(f"array_max({ends})", "e", f"if(e is null, named_struct('next', i + 1, 'out', concat(s.out, array(g[i - 1]))), named_struct('next', e + 1, 'out', concat(s.out, array({card}))))")
    return _let(f"split({chain}, ' ')", "g", f"aggregate(sequence(1, size(g)), named_struct('next', 1, 'out', cast(array() as array<string>)), (s, i) -> if(i < s.next, s, {step}), s -> array_join(s.out, ' '))")


@lru_cache(1)
def _own_key() -> str:
    return secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The key that the session's spark.quillspark.pii.key or the file named in QUILLSPARK_PII_KEY_FILE holds.

    Without either a random one of this application, so that nobody can turn pseudonyms back: values then stay linked
    within the application, not between runs. The key is part of the plan, so keep event logs as safe as the key.
    """
    named, path = spark.conf.get("spark.quillspark.pii.key", ""), os.environ.get("QUILLSPARK_PII_KEY_FILE")
    if not named and path:
        with open(path) as f:
            named = f.read().strip()
    return hashlib.sha256(named.encode()).hexdigest() if named else _own_key()


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs with text rewritten, and entities: array of struct(kind, start, end) in the text as it was.

    key: letters, digits, - and _ only. Offsets are code points, the end is exclusive. A null text stays null with no
    entities; an empty one likewise; long texts are searched whole. Columns named entities or beginning with _pii are
    replaced. Repeated rows stay; an empty table gives an empty result.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", key):
        raise ValueError("the key may hold letters, digits, - and _ only")
    if "text" not in docs.columns:
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    odd = F.col("text").contains(MARK)
    chains = F.struct(F.regexp_extract_all("text", F.lit(CHAIN), F.lit(0)).alias("old"), F.split("text", CHAIN, -1).alias("gaps"))
    found = docs.drop("entities", "_pii", "_pii_text").withColumn("_pii", F.when(F.col("text").rlike(CHAIN) & ~odd, chains))
    cards = F.expr(f"concat(array_join(zip_with(slice(_pii.gaps, 1, size(_pii.old)), _pii.old, (g, o) -> concat(g, {_marked('o')})), ''), element_at(_pii.gaps, -1))")
    found = found.withColumn("_pii_text", F.when(F.col("_pii").isNotNull(), cards).otherwise(F.col("text")))

    def matches(pattern: str) -> Column:
        old = F.regexp_extract_all("_pii_text", F.lit(pattern), F.lit(0))
        return F.struct((old if pattern == PLAIN else F.transform(old, lambda x: F.replace(x, F.lit(MARK), F.lit("")))).alias("old"), F.split("_pii_text", pattern, -1).alias("gaps"))

    some = F.col("text").rlike("[0-9@]")
    found = found.withColumn("_pii", F.when(some & odd & F.col("_pii_text").rlike(PLAIN), matches(PLAIN)).when(some & ~odd & F.col("_pii_text").rlike(ANY), matches(ANY)))
    new = F.expr(f"transform(_pii.old, x -> {pseudonym('x', key)})")
    found = found.withColumn("_pii", F.when(F.col("_pii").isNotNull(), F.struct("_pii.old", "_pii.gaps", new.alias("new"))))
    text = F.expr("concat(array_join(zip_with(slice(_pii.gaps, 1, size(_pii.old)), zip_with(_pii.old, _pii.new, (o, n) -> coalesce(n.new, o)), (g, v) -> concat(g, v)), ''), element_at(_pii.gaps, -1))")
    spans = F.expr("""filter(aggregate(sequence(1, size(_pii.old)), named_struct('at', 0L, 'out', cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)),
        (s, i) -> named_struct('at', s.at + length(element_at(_pii.gaps, i)) + length(element_at(_pii.old, i)),
            'out', concat(s.out, array(named_struct('kind', element_at(_pii.new, i).kind, 'start', s.at + length(element_at(_pii.gaps, i)), 'end', s.at + length(element_at(_pii.gaps, i)) + length(element_at(_pii.old, i)))))),
        s -> s.out), e -> e.kind is not null)""")
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    at = F.col("_pii").isNotNull()
    return found.withColumns({"text": F.when(at, text).otherwise(F.col("text")), "entities": F.when(at, spans).otherwise(none)}).drop("_pii", "_pii_text")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(rows_of(documents(spark, sf_dir), doc_id="long", text="string"), key_of(spark))
    spans: Column = F.expr("array_join(transform(entities, e -> concat_ws(':', e.kind, e.start, e.end)), ',')")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), spans.alias("spans"))
