r"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Only built-in SQL functions run. A kind's matches come from regexp_extract_all and
the gaps between them from split by the same pattern, so a match's place is the
sum of the lengths before it, in code points. Patterns use possessive loops: Java
then needs neither stack nor backtracking on long runs, and a look-behind lets a
match begin only where a run begins, which keeps the leftmost matches and makes
the search linear.

Kinds email, ip, card and phone are base kinds: a match that passes its check is
kept whatever its score. iban (mod-97) and ssn (area, group and serial numbers)
are added by the method if their score, context words included, reaches KEEP.

Folds run in blocks and texts are cut from pieces, so that a text with very many spans
costs what its spans do.

Defined results: a null text counts as empty and has no spans; an empty table
gives an empty table; repeated rows are searched each time; columns of the input
named like one that is added are replaced. Overlapping spans of several kinds are
all reported; redact() merges them and names the kind that starts first, the
kind listed first on a tie. Texts of any length are searched whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tables import table

LOCAL = r"A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """gate: a cheap condition on text t without which nothing matches; check: a condition on match m."""

    name: str
    pattern: str
    gate: str
    check: str
    score: float
    near: str
    base: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Each second digit from the right doubled, less 9 if above 9; the sum ends in 0.
_LUHN = f"""(aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) ->
  CASE WHEN i % 2 = 0 THEN CAST(d AS INT) WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END),
  0, (a, x) -> a + x) % 10 = 0)"""
#: The first four characters go last, letters count 10 to 35, and the number leaves 1 over 97.
_MOD97 = """(length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND
  aggregate(split(concat(substr(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), 0, (a, c) ->
  CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1)"""

KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0", "true", 0.9, "e-?mail|correo|courriel|contact|kontakt", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t RLIKE r'[0-9]\.[0-9]'", "forall(split(m, '[.]'), x -> length(trim(LEADING '0' FROM x)) <= 3 AND CAST(right(x, 3) AS INT) <= 255)", 0.7, r"\bip\b|host|server|address|adresse", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![0-9])(?![ -][0-9])", "t RLIKE r'[0-9](?:[ -]?[0-9]){15}'", _LUHN, 0.8, "card|carte|karte|tarjeta|visa|credit|debit", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "instr(t, '+') > 0", f"length({_DIGITS}) BETWEEN 8 AND 15", 0.7, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", _MOD97, 0.7, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'", 0.4, "ssn|social|security"),
)
NEAR = 40  # code points of context on either side
BONUS = 0.2
KEEP = 0.6
BASE = tuple(k.name for k in KINDS if k.base)
BLOCK = 64  # spans folded at a time
PIECE = 1024  # code points of a text's pieces
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _fold(items: str, state: str, kind: str, step: str) -> str:
    """SQL for the array of what a fold emits: its work and memory are in proportion to the items.

    items is an array i of which each element x turns state s into step, a struct (s, out)
    with out an array of `kind` to emit. Appending to one array would copy it for each
    element, so BLOCK elements are folded at a time and their arrays joined once.
    """
    empty = f"CAST(array() AS ARRAY<{kind}>)"
    inner = f"""aggregate(slice(z.i, CAST(b * {BLOCK} + 1 AS INT), {BLOCK}), struct(a.s AS s, {empty} AS found),
        (c, x) -> aggregate(array({step.replace('{s}', 'c.s')}), c, (c, y) -> struct(y.s AS s, concat(c.found, y.out) AS found)),
        c -> struct(c.s AS s, concat(a.found, array(c.found)) AS found))"""
    return f"""aggregate(array(struct({items} AS i)), {empty}, (none, z) -> aggregate(sequence(0, CAST(ceil(size(z.i) / {BLOCK}) AS INT)),
      struct({state} AS s, CAST(array() AS ARRAY<ARRAY<{kind}>>) AS found), (a, b) -> {inner}, a -> flatten(a.found)))"""


def _spans(kind: Kind) -> str:
    """SQL for the array of SPAN of one kind in text t."""
    rank = f"round(least(1D, {kind.score}D + CASE WHEN lower(concat(right(x.g, {NEAR}), ' ', left(x.h, {NEAR}))) RLIKE r'{kind.near}' THEN {BONUS}D ELSE 0D END), 2)"
    keep = "true" if kind.base else f"y.score >= {KEEP}D"
    # each match m with the gaps g before and h after it
    items = f"""aggregate(array(struct(regexp_extract_all(t, r'{kind.pattern}', 0) AS m, split(t, r'{kind.pattern}', -1) AS g)), CAST(array() AS ARRAY<STRUCT<m:STRING,g:STRING,h:STRING>>),
      (none, w) -> transform(w.m, (m, i) -> struct(m, w.g[i] AS g, w.g[i + 1] AS h)))"""
    start = "({s} + length(x.g))"
    found = f"filter(transform(array(x.m), m -> struct({kind.check} AS ok, '{kind.name}' AS kind, {start} AS start, {start} + length(m) AS end, {rank} AS score)), y -> y.ok AND {keep})"
    fold = _fold(items, "0L", f"STRUCT<ok:BOOLEAN,{SPAN[7:-1]}>", f"struct({start} + length(x.m) AS s, {found} AS out)")
    return f"CASE WHEN {kind.gate} THEN {fold} ELSE CAST(array() AS ARRAY<STRUCT<ok:BOOLEAN,{SPAN[7:-1]}>>) END"


def find_pii(docs: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """All columns of docs and `pii_spans`: kind, start, end (code points, end exclusive) and score, by kind as listed, then start."""
    own = [c for c in docs.columns if c != "pii_spans"]
    found = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    spans = ", ".join(_spans(k).replace("(t,", "(__t,").replace("t RLIKE", "__t RLIKE") for k in kinds)
    return found.select(*own, F.expr(f"transform(concat({spans}), x -> struct(x.kind, x.start, x.end, x.score))").alias("pii_spans"))


def redact(docs: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; a null text stays null."""
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"))
    order = ", ".join(f"'{k.name}', {i}" for i, k in enumerate(kinds))
    # each span with the kind of the first that it touches; what it touches is emitted as one
    empty = "CAST(NULL AS STRUCT<s:BIGINT,e:BIGINT,kind:STRING>)"
    spans = f"""concat(sort_array(transform(pii_spans, x -> struct(x.start AS s, map({order})[x.kind] AS k, x.end AS e, x.kind AS kind))),
      array(struct(CAST(NULL AS BIGINT) AS s, 0 AS k, CAST(NULL AS BIGINT) AS e, '' AS kind)))"""
    step = f"""CASE WHEN {{s}} IS NOT NULL AND x.s < {{s}}.e
      THEN struct(struct({{s}}.s AS s, greatest({{s}}.e, x.e) AS e, {{s}}.kind AS kind) AS s, CAST(array() AS ARRAY<STRUCT<s:BIGINT,e:BIGINT,kind:STRING>>) AS out)
      ELSE struct(struct(x.s AS s, x.e AS e, x.kind AS kind) AS s, filter(array({{s}}), y -> y IS NOT NULL) AS out) END"""
    merged = _fold(spans, empty, "STRUCT<s:BIGINT,e:BIGINT,kind:STRING>", step)
    # substr() counts from a text's beginning, so the gaps are cut from pieces of it
    start, end = "(CASE WHEN i = 0 THEN 0L ELSE z.m[i - 1].e END)", "(CASE WHEN i = size(z.m) THEN CAST(length(__text) AS BIGINT) ELSE z.m[i].s END)"
    gap = f"""CASE WHEN {start} >= {end} THEN '' ELSE array_join(transform(sequence({start} div {PIECE}, ({end} - 1) div {PIECE}), p ->
      substr(z.p[CAST(p AS INT)], CAST(greatest({start} - p * {PIECE}, 0L) + 1 AS INT), CAST(least({end} - p * {PIECE}, {PIECE}L) - greatest({start} - p * {PIECE}, 0L) AS INT))), '') END"""
    joined = f"array_join(transform(sequence(0, size(z.m)), i -> concat({gap}, CASE WHEN i = size(z.m) THEN '' ELSE concat('[', upper(z.m[i].kind), ']') END)), '')"
    # spans and pieces are bound once: what stands in a lambda is computed for each element
    clean = F.expr(f"""CASE WHEN size(pii_spans) = 0 THEN __text ELSE
      aggregate(array(struct({merged} AS m, regexp_extract_all(__text, r'(?s).{{1,{PIECE}}}', 0) AS p)), '', (none, z) -> {joined}) END""")
    found = find_pii(row, "__text", kinds).select("__row", clean.alias("__clean"))
    return found.select(*(F.col("__clean").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(pii_spans, x -> x.kind IN ({}))".format(", ".join(f"'{k}'" for k in BASE))
    return find_pii(docs).select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(pii_spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"),
        F.expr(joined.format("pii_spans")).alias("spans"),
    )
