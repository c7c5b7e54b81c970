"""Secret scans: three base patterns, and sliding-window Shannon entropy of candidate strings.

DataFrame functions only. A kind's matches are taken leftmost and without
overlap; their places follow from the lengths of the matches and of the pieces
between them, in code points.

Added spans. A candidate is a run of at least ``WINDOW`` characters of a class:
hexadecimal (kind entropy_hex), or letters, digits and +/_=- with at least one
letter and one digit (kind entropy_text). A window of ``WINDOW`` characters
slides over it; as a character enters and another leaves, two counts change,
and the sum of n log2 n is carried along. A candidate is reported if the
highest entropy of a window reaches its class's threshold, unless the allow
list knows it. Known wholes (UUIDs, digests of nothing, a documented example
key) suppress a candidate; known words (alphabets, "example") suppress only the
windows that touch them, so what stands beside such a word is still examined.

Defined results: a null text counts as empty and has no spans; repeated rows
are returned once each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the least length can stand in these patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
PART = 512  # matches that are placed at once
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")
THRESHOLDS = {"entropy_hex": 3.0, "entropy_text": 3.7}
# Fixed values of the allow list: whole candidates, and words within them.
KNOWN = (
    r"^(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"  # UUID
    r"|da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    r"|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY)$"
)
KNOWN_WORDS = "abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789abcdef|1234567890123456|EXAMPLE|example|placeholder"

_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the matches, in order.

    Each match adds to an array, which is copied; so matches are placed in parts of ``PART``, and only
    the list of parts grows with the text.
    """
    gaps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))
    placed = "array<struct<start:int,end:int,found:string>>"

    def step(have: Column, x: Column) -> Column:
        begin = have["at"] + x["gap"]
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(have["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    def part(have: Column, rows: Column) -> Column:
        start = F.struct(have["at"].alias("at"), F.array().cast(placed).alias("out"))
        done = F.aggregate(rows, start, step)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(have["out"], F.array(d["out"])).alias("out")))

    def place(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(PART)), lambda k: F.slice(rows, k, F.lit(PART)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{placed}>").alias("out"))
        return F.aggregate(parts, start, part, lambda have: F.flatten(have["out"]))

    # The piece after the last match stands without a match.
    found = F.filter(gaps, lambda x: x["found"].isNotNull())
    return _let(found, lambda rows: F.when(F.size(rows) > 0, place(rows)).otherwise(F.array().cast(placed)))


def _span(x: Column, kind: Column) -> Column:
    return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"))


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the candidate's windows, by incremental counts."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    slots = len(_ALPHABET) + 1
    start = F.struct(F.array_repeat(F.lit(0), slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def slot(character: Column) -> Column:
        """1 to the alphabet's length; 0, shared by all others, becomes the last slot."""
        at = F.instr(F.lit(_ALPHABET), character)
        return F.when((at > 0) & (character != ""), at).otherwise(F.lit(slots))

    def slide(places: Column) -> Column:
        def step(have: Column, i: Column) -> Column:
            enters, leaves = F.element_at(places, i), F.when(i > window, F.element_at(places, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            up = F.element_at(have["counts"], enters)
            down = F.element_at(have["counts"], F.greatest(leaves, F.lit(1)))
            total = F.when(enters == leaves, have["sum"]).otherwise(
                have["sum"] + F.element_at(weight, up + 2) - F.element_at(weight, up + 1) + F.when(leaves > 0, F.element_at(weight, down) - F.element_at(weight, down + 1)).otherwise(F.lit(0.0))
            )
            counts = F.transform(have["counts"], lambda n, k: n + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window, F.least(have["least"], total)).otherwise(have["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda have: F.lit(math.log2(window)) - have["least"] / window)

    # Characters are told apart once: to find the n-th one in a string takes n steps.
    return _let(F.transform(F.split(candidate, ""), slot), slide)


def _entropy_spans(text: Column) -> Column:
    hexadecimal = lambda x: x["found"].rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")

    def likely(x: Column) -> Column:
        least = F.when(hexadecimal(x), F.lit(THRESHOLDS["entropy_hex"])).otherwise(F.lit(THRESHOLDS["entropy_text"]))

        def reaches(piece: Column) -> Column:
            telling = (F.length(piece) >= WINDOW) & (hexadecimal(x) | (piece.rlike("[A-Za-z]") & piece.rlike("[0-9]")))
            return F.when(telling, F.round(highest_entropy(piece), 9) >= least).otherwise(F.lit(False))

        return F.when(x["found"].rlike(KNOWN), F.lit(False)).otherwise(F.exists(F.split(x["found"], KNOWN_WORDS, -1), reaches))

    return F.transform(F.filter(_located(text, CANDIDATE), likely), lambda x: _span(x, F.when(hexadecimal(x), F.lit(3)).otherwise(F.lit(4))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.filter(_located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
    found = {
        "assign": F.when(text.rlike(ASSIGN), F.transform(kept, lambda x: _span(x, F.lit(0)))),
        "access": F.when(text.contains("AKIA"), F.transform(_located(text, ACCESS), lambda x: _span(x, F.lit(1)))),
        "hex": F.when(text.rlike(HEX), F.transform(_located(text, HEX), lambda x: _span(x, F.lit(2)))),
        "entropy": F.when(text.rlike(CANDIDATE), _entropy_spans(text)),
    }
    each = docs.select("doc_id", *[F.coalesce(c.cast(_SPANS), _none()).alias(k) for k, c in found.items()])
    base = F.concat("assign", "access", "hex")
    return each.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.sort_array(base)), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat(base, "entropy"))).alias("spans"),
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: DuckDB's case folding knows letters outside ASCII, so both cases are written out.
_ASSIGN_SQL = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))).replace("'", "''")


def _located_sql(pattern: str) -> str:
    """Rows (r, start, stop, found) of a pattern's matches in the table ``d`` (r, text)."""
    return f"""(
        SELECT r, found, sum(gap + length(found)) OVER (PARTITION BY r ORDER BY k) AS stop, stop - length(found) AS start
        FROM (SELECT r, unnest(range(len(f))) AS k, unnest(f) AS found, unnest(list_transform(g, lambda x: length(x))[:len(f)]) AS gap
              FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM d) WHERE len(f) > 0))"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
candidates AS (SELECT row_number() OVER () AS c, *, regexp_full_match(found, '[0-9a-f]+|[0-9A-F]+') AS hexadecimal
               FROM {_located_sql(CANDIDATE)} WHERE NOT regexp_matches(found, '{KNOWN}')),
parts AS (SELECT c, hexadecimal, row_number() OVER () AS p, piece
          FROM (SELECT c, hexadecimal, unnest(string_split_regex(found, '{KNOWN_WORDS}')) AS piece FROM candidates)
          WHERE length(piece) >= {WINDOW} AND (hexadecimal OR (regexp_matches(piece, '[A-Za-z]') AND regexp_matches(piece, '[0-9]')))),
windows AS (SELECT c, p, k, unnest(string_split(substr(piece, k, {WINDOW}), '')) AS letter
            FROM (SELECT c, p, piece, unnest(range(1, length(piece) - {WINDOW} + 2)) AS k FROM parts)),
entropies AS (SELECT c, p, k, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS bits
              FROM (SELECT c, p, k, letter, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
highest AS (SELECT c, round(max(bits), 9) AS bits FROM entropies GROUP BY c),
spans AS (
    SELECT r, start, 0 AS kind, stop FROM {_located_sql(_ASSIGN_SQL)} WHERE length(regexp_extract(found, '{_ASSIGN_SQL}', 2)) >= 6
    UNION ALL SELECT r, start, 1, stop FROM {_located_sql(ACCESS)}
    UNION ALL SELECT r, start, 2, stop FROM {_located_sql(HEX)}
    UNION ALL SELECT r, start, CASE WHEN hexadecimal THEN 3 ELSE 4 END, stop FROM candidates JOIN highest USING (c)
        WHERE bits >= CASE WHEN hexadecimal THEN {THRESHOLDS["entropy_hex"]} ELSE {THRESHOLDS["entropy_text"]} END),
named AS (SELECT *, ['{"', '".join(KINDS)}'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS name FROM spans),
joined AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans
    FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""
