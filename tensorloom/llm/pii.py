"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

All steps are column expressions over one row. A pattern's matches and the pieces of text
between them (`regexp_extract_all` and `split` by the same pattern) give the place of each
match by running sums of lengths. No pattern nests repetitions, and each can start only
where a run of its characters starts or a match has just ended, so very long texts cost
time in proportion to their length and no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Characters that stand for others of the same width while runs of digits are sought.
MARK, OTHER = "\x01", "\x02"
#: Characters on each side of a span that count as its context.
REACH = 40
#: Score from which a span of the method's own kinds is reported.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """How one kind is proposed (pattern over `over`), confirmed (SQL over x) and scored."""

    name: str
    pattern: str
    needs: str  # SQL over _text: false means that no match is possible
    valid: str
    score: float
    context: str
    bonus: float
    base: bool
    over: str = "_text"
    marks: str = ""  # what MARK stands for in a match


LUHN = (
    "aggregate(sequence(1, length(x)), 0, (a, i) -> a + IF(i % 2 = 1, int(substr(x, -i, 1)), "
    "IF(int(substr(x, -i, 1)) > 4, 2 * int(substr(x, -i, 1)) - 9, 2 * int(substr(x, -i, 1))))) % 10 = 0"
)
MOD97 = (
    "aggregate(sequence(1, length(x)), 0, (a, i) -> IF(substr(concat(substr(x, 5), substr(x, 1, 4)), i, 1) RLIKE '[0-9]', "
    "(a * 10 + ascii(substr(concat(substr(x, 5), substr(x, 1, 4)), i, 1)) - 48) % 97, "
    "(a * 100 + ascii(substr(concat(substr(x, 5), substr(x, 1, 4)), i, 1)) - 55) % 97)) = 1"
)


def _on(digits: str, test: str) -> str:
    """test with its x replaced by an expression over the match x."""
    return f"exists(array({digits}), x -> {test})"


KINDS = (
    Kind("email", rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++",
         "contains(_text, '@')", "true", 0.9, "mail|contact|write", 0.1, True, "_dots", "."),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"_text RLIKE '[0-9][.][0-9]'",
         "forall(split(x, '[.]'), p -> length(ltrim('0', p)) < 3 OR length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255')",
         0.7, "ip|host|server|address", 0.2, True),
    Kind("card", f"[0-9{MARK}]{{13,}}", "_runs != ''",
         f"length(translate(x, '{MARK}', '')) BETWEEN 13 AND 19 AND " + _on(f"translate(x, '{MARK}', '')", LUHN),
         0.8, "card|visa|pay|credit", 0.2, True, "_runs"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(_text, '+')", "length(regexp_replace(x, '[^0-9]', '')) BETWEEN 9 AND 15",
         0.7, "tel|phone|call|mobile", 0.2, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "_text RLIKE '[A-Z][A-Z][0-9][0-9]'",
         "length(translate(x, ' ', '')) BETWEEN 15 AND 34 AND " + _on("translate(x, ' ', '')", MOD97),
         0.8, "iban|account|konto|bank", 0.2, False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])", "_text RLIKE '[0-9a-fA-F]{32}'", "x RLIKE '[0-9]' AND x RLIKE '[A-Fa-f]'",
         0.3, "token|secret|passw|api.?key|credential", 0.5, False),
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _steps(kind: Kind) -> list[dict[str, str]]:
    """Columns, in order, that end in _<kind>: array<struct<kind, start, end, value, score>>.

    A match ends where the lengths of all pieces up to it add up to. The sums run over
    blocks of 256, so that thousands of matches don't cost the square of their number.
    """
    n, pattern = kind.name, _sql(kind.pattern)
    m, gaps, widths, sums, before, ends, valid = (f"_{c}_{n}" for c in ("m", "gaps", "widths", "sums", "before", "ends", "valid"))
    value = "x.value" if kind.over == "_text" else f"translate(x.value, '{MARK}', '{kind.marks}')"
    near = f"lower(concat_ws(' ', right(get({gaps}, k), {REACH}), left(get({gaps}, k + 1), {REACH})))"
    score = f"least(1.0D, {kind.score}D + IF(x.near RLIKE {_sql(kind.context)}, {kind.bonus}D, 0.0D))"
    add = "0, (a, y) -> a + y"
    return [
        {m: f"IF({kind.needs}, regexp_extract_all({kind.over}, {pattern}, 0), array())"},
        {gaps: f"IF(size({m}) > 0, split({kind.over}, {pattern}, -1), array())"},
        {widths: f"transform({m}, (x, k) -> length(x) + length(get({gaps}, k)))"},
        {sums: f"IF(size({m}) > 0, transform(sequence(0, int((size({m}) - 1) div 256)), b -> aggregate(slice({widths}, b * 256 + 1, 256), {add})), array())"},
        {before: f"transform({sums}, (z, b) -> aggregate(slice({sums}, 1, b), {add}))"},
        {ends: f"transform({m}, (x, k) -> struct(x AS value, get({before}, int(k div 256)) + aggregate(slice({widths}, int(k div 256) * 256 + 1, k % 256 + 1), {add}) AS end, {near} AS near))"},
        {valid: f"transform(filter({ends}, r -> exists(array(r.value), x -> {kind.valid})), r -> struct(r.end - length(r.value) AS start, r.end AS end, r.value AS value, r.near AS near))"},
        {f"_{n}": f"transform({valid}, x -> struct('{n}' AS kind, x.start AS start, x.end AS end, {value} AS value, {score} AS score))"},
    ]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS, threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id and `found`, its spans by kind as listed, then start.

    A span has kind, start, end (code points, end exclusive), value and score; the value
    of a card is its digits alone. Base kinds
    are reported whatever their score; the others from `threshold` on. Null texts count
    as empty and have no spans; repeated rows are searched each for itself; an empty
    table gives an empty result; further columns of docs are not read but for
    `carry`, which is passed through.
    """
    held = [F.col(carry)] if carry else []
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *held)
    text = F.translate("_text", MARK, OTHER)
    runs = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", MARK)
    dots = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    t = t.withColumns(
        {
            "_runs": F.when(F.col("_text").rlike("[0-9][0-9 -]{11,}[0-9]"), runs).otherwise(""),
            "_dots": F.when(F.contains("_text", F.lit("@")), dots).otherwise(""),
        }
    )
    for steps in zip(*[_steps(k) for k in kinds]):
        t = t.withColumns({name: F.expr(e) for step in steps for name, e in step.items()})
    own = [f"_{k.name}" if k.base else f"filter(_{k.name}, x -> x.score >= {threshold})" for k in kinds]
    row = F.struct("doc_id", F.expr(f"concat({', '.join(own)})").alias("found"), *[carry] * bool(carry))
    # inline() keeps a later filter on the spans from being pushed into these steps
    return t.select(F.inline(F.array(row)))


def listed(spans: str) -> str:
    """SQL: kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def summary(found: DataFrame, kinds=KINDS) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and the highest score."""
    base = [k.name for k in kinds if k.base]
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{n}'))").cast("long").alias(f"n_{n}") for n in base]
    mine = f"filter(found, x -> x.kind IN ({', '.join(map(_sql, base))}))"
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.encode(F.expr(listed(mine)), "UTF-8"), 256).alias("base_sha256"),
        F.expr(listed("found")).alias("spans"),
        F.expr("array_max(transform(found, x -> x.score))").alias("max_score"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every found span of the text replaced by its kind in brackets.

    Of spans that overlap, the one that starts first is replaced and the rest are
    swallowed by it. The work is done in place, without a join; its cost is the length of
    a text times the number of its spans.
    """
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("_row"))
    found = find_pii(held, f"_row.{quoted(id_col)}", f"_row.{quoted(text_col)}", kinds, threshold, carry="_row")
    text = f"_row.{quoted(text_col)}"
    ordered = "array_sort(transform(found, x -> struct(x.start AS start, x.end AS end, x.kind AS kind)))"
    step = (
        f"IF(x.start < a.at, struct(greatest(a.at, x.end) AS at, a.out AS out), struct(x.end AS at, "
        f"concat(a.out, substr({text}, a.at + 1, x.start - a.at), '[', x.kind, ']') AS out))"
    )
    clean = f"IF(size(found) = 0, {text}, aggregate({ordered}, struct(0 AS at, '' AS out), (a, x) -> {step}, a -> concat(a.out, substr({text}, a.at + 1))))"
    return found.select(*[F.expr(clean).alias(c) if c == text_col else F.col(f"_row.{quoted(c)}") for c in columns])
