"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from . import licenses

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
      FROM t LEFT JOIN c USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
                + 32 * (2 * n_capitals > word_chars)::INT)::INT AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, 'v1' AS policy FROM f
"""


OP7 = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT html, max(page_id) AS keep FROM t WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(t.html) AS payload_digest,
       CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM t LEFT JOIN g ON t.html = g.html
"""


ABLATION = f"""
WITH f AS ({OP3}), rules AS (SELECT unnest(['too_short', 'repeated_windows', 'symbols', 'word_length', 'repeated_lines', 'capitals']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_only, count(*) FILTER (failed & ~bit = 0) AS n_kept_without, count(*) AS n_rows FROM f, rules GROUP BY rule
"""

#: Patterns of the base kinds as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {DIGITS}[-k]::INT
    ELSE 2 * {DIGITS}[-k]::INT - CASE WHEN {DIGITS}[-k]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0",
    "card": f"CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}


def _spans(k: int, kind: str) -> str:
    """Spans of a kind: matches and the gaps between them take turns, so their lengths add up to places."""
    return f"""SELECT doc_id, {k} AS o, '{kind}' AS kind, v, s + before AS start, s + before + length(v) AS stop FROM (
    SELECT doc_id, v, sum(length(gap)) OVER w AS s, coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT doc_id, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v, unnest(gaps[1:len(vs)]) AS gap FROM (
            SELECT doc_id, regexp_extract_all(text, '{BASE[kind]}') AS vs, regexp_split_to_array(text, '{BASE[kind]}') AS gaps FROM t)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {VALID[kind]}"""


PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans(k, kind) for k, kind in enumerate(BASE))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN a USING (doc_id)
"""

# sources fill up in order of cap / weight; the level is that of the first one that the rest doesn't fill
TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM g),
c AS (SELECT *, cap / weight AS full_at, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT arg_min(((SELECT 1.5::DOUBLE * sum(source_size) FROM g) - held) / open, full_at) AS level FROM c WHERE ((SELECT 1.5::DOUBLE * sum(source_size) FROM g) - held) / open < full_at)
SELECT d.doc_id, d.size, c.source_size, round(CASE WHEN level IS NULL OR full_at <= level THEN cap ELSE weight * level END, 3) AS target
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, l
"""



def _kmeans(k: int = 40, rounds: int = 5) -> str:
    """Assignments and means of every round written out, one after another."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER o - 1 AS c, v AS m FROM v WINDOW o AS (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) QUALIFY row_number() OVER o <= {k})",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS best FROM (SELECT id, vec_id, v, c, {apart} AS d FROM (SELECT row_number() OVER () AS id, * FROM v), c{r}) GROUP BY id)")
        if r < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"  # floor of an exact quotient
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} AS o LEFT JOIN (SELECT c, list(m ORDER BY i) AS m FROM (
    SELECT best[2] AS c, i, ({mean})::BIGINT AS m FROM (SELECT best, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY c) AS n USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best[2] = c"""



OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, k, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p, unnest([1, 2, 3, 4]) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i))
                   GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, string_split(g, ' ') AS w, g, k, f FROM f WHERE k > 1),
x AS MATERIALIZED (SELECT lang, g, f AS a, cut, array_to_string(w[1:cut], ' ') AS lg, array_to_string(w[cut + 1:], ' ') AS rg FROM s, unnest([1, 2, 3]) AS u(cut) WHERE cut < k),
c AS (SELECT x.lang, x.g, a, l.f AS l, r.f AS r, (2000000 * a::HUGEINT // (l.f::HUGEINT + r.f))::BIGINT AS score FROM x JOIN f AS l ON l.lang = x.lang AND l.g = lg JOIN f AS r ON r.lang = x.lang AND r.g = rg
      QUALIFY row_number() OVER (PARTITION BY x.lang, x.g ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(f) AS around FROM s, unnest([2, 3]) AS u(m), unnest(range(1, k - m + 2)) AS v(i) WHERE m < k GROUP BY ALL)
SELECT c.lang, row_number() OVER z AS rank, c.g AS phrase, a, l, r, n, score
FROM c JOIN t ON t.lang = c.lang LEFT JOIN o ON o.lang = c.lang AND o.g = c.g WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT
WINDOW z AS (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.g) QUALIFY row_number() OVER z <= 2000
"""


def _pattern(parts: tuple, spellings: dict[str, list[str]]) -> str:
    """A template as a pattern over words that each have a blank behind them."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f"(?:{'|'.join([p, *spellings.get(p, [])])}) "
        elif isinstance(p, licenses.Optional):
            out += f"(?:{_pattern(p.parts, spellings)})?"
        elif p.texts:
            out += f"(?:{'|'.join(_pattern(t, spellings) for t in p.texts)})"
        else:
            out += f"(?:[^ ]+ ){{{p.least},{p.most}}}"
    return out


def _licenses() -> str:
    places = " || ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = ' + repr(x) for k, x in enumerate(phrase.split()))})" for phrase in licenses.BASE
    )
    tests = [(label, licenses.parse(markup), licenses.SPELLINGS if spelled else {}) for label, markup, spelled in licenses.all_templates()]
    held = lambda value: "[" + ", ".join(f"CASE WHEN regexp_matches(s, ' {_pattern(parts, spellings)}') THEN {value(label, parts)} END" for label, parts, spellings in tests) + "]"
    base = ", ".join(f"CASE WHEN contains(s, ' {phrase} ') THEN '{label}' END" for phrase, label in licenses.BASE.items())
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter({xs}, lambda x: x IS NOT NULL))), ',')"
    score = lambda _, parts: f"{licenses.strength(len(licenses.mandatory(parts)))!r}::DOUBLE"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{licenses.WORD.pattern}') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {places} AS places FROM w)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, {joined(f"[{base}]")} AS base_labels,
       {joined(held(lambda label, _: repr(label)))} AS labels, coalesce(list_max({held(score)}), 0.0::DOUBLE) AS score
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1, "op3_quality_rules": OP3, "op7_warc": OP7, "op11_kmeans": _kmeans(), "op12_collocations": OP12, "op13_licenses": _licenses(),
        "rules_ablation": ABLATION, "pii_base": PII, "mixing_targets": TARGETS,
    }
