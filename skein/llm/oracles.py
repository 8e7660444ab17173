"""DuckDB SQL for the operators that SQL can express; parameters are those of the operators."""

from __future__ import annotations

from . import license, pii, quality

WARC = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
             list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST('0b' || substr(bits, 1 + 5 * CAST(i AS INTEGER), 5) AS INTEGER), 1)), 'string_agg', '') AS d
      FROM (SELECT page_id, url, html, sha1(coalesce(html, '')) AS hex,
                   list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''),
                     lambda c: right(bin(CAST('0x' || c AS INTEGER) + 16), 4)), 'string_agg', '') AS bits
            FROM pages))
"""

#: Every pair of a label, by cosine in double precision; components by reachability.
PQ = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
JOIN (SELECT e.vec_id, count(l.b) AS n_links FROM embeddings e LEFT JOIN links l ON e.vec_id = l.a GROUP BY e.vec_id) USING (vec_id)
"""


def quality_sql() -> str:
    """Counts by lists and windows; every cutoff tested with the binomial distribution written out."""
    rules = quality.RULES
    share = quality.ALPHA / len(rules)
    values = ", ".join(f"{r.value} AS v_{r.name}" for r in rules)
    grid = " UNION ALL ".join(f"SELECT {i} AS rule, unnest([{', '.join(map(str, r.cutoffs))}]) AS cutoff" for i, r in enumerate(rules))
    value_of = "CASE rule " + " ".join(f"WHEN {i} THEN v_{r.name}" for i, r in enumerate(rules)) + " END"
    rejected = " OR ".join(f"coalesce(v_{r.name} > (SELECT cutoff FROM best b WHERE b.lang IS NOT DISTINCT FROM f.lang AND b.rule = {i}), false)" for i, r in enumerate(rules))
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
win AS (SELECT r, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM l)),
hit AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, sum(least({quality.WINDOW}, d)) AS n FROM (SELECT r, i - lag(i, 1, i - {quality.WINDOW}) OVER (PARTITION BY r ORDER BY i) AS d FROM hit) GROUP BY r),
c AS (SELECT r, doc_id, lang, len(ws) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
      len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct_words, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper FROM l LEFT JOIN rep USING (r)),
f AS (SELECT *, {values}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
held AS (SELECT doc_id, bool_and(quality = 1) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT * FROM f JOIN held USING (doc_id) WHERE NOT base_failed),
tested AS (SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {value_of} > cutoff) AS k, count(*) FILTER (NOT good AND {value_of} > cutoff) AS bad
           FROM seen, ({grid}) GROUP BY lang, rule, cutoff),
p AS (SELECT *, CASE WHEN n = 0 OR k >= {share} * n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p FROM tested),
best AS (SELECT lang, rule, cutoff FROM p WHERE p <= {quality.DELTA} / ({len(rules)} * (SELECT greatest(1, count(DISTINCT {{'s': lang}})) FROM seen)) AND bad - {quality.COST} * k > 0
         QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - {quality.COST} * k DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept FROM f
"""


def license_sql() -> str:
    """The cosine of every cue unit with every template, then the nearest ancestor by joins.

    The full licence texts are left out: no whole text of the tables is one."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(name)}, {quote(t)})" for i, (name, t) in enumerate(license.TEMPLATES))
    terms = "regexp_extract_all(lower({}), '[0-9]+(?:\\.[0-9]+)+|[\\p{{L}}\\p{{N}}]+')".format
    cue = quote(license.CUE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE doc_id % 10 WHEN 0 THEN concat_ws('/', source, lang, 'LICENSE-' || doc_id) WHEN 5 THEN concat_ws('/', source, lang, 'p' || (doc_id % 7), 'LICENSE-' || doc_id) ELSE concat_ws('/', source, lang, 'p' || (doc_id % 7), CAST(doc_id AS VARCHAR)) END AS path, coalesce(text, '') AS t FROM documents),
tpl AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms('x')}) AS term FROM (VALUES {templates}) v(template, license, x)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT r, unnest(list_distinct({terms('t')})) AS term FROM d) WHERE term IN (SELECT term FROM tpl) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tpl) LEFT JOIN df USING (term)),
tw AS (SELECT template, license, term, tf * idf AS w FROM tpl JOIN idf USING (term)),
tn AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS tw FROM tw),
cut AS (SELECT r, unnest(list_concat(list_concat(
          list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {cue})), lambda x: {{'whole': false, 't': x}}),
          list_transform(CASE WHEN len(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n')) > 1 THEN list_filter(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), lambda x: regexp_matches(x, {cue})) ELSE [] END, lambda x: {{'whole': false, 't': x}})),
          [{{'whole': true, 't': t}}])) AS u FROM d WHERE regexp_matches(t, {cue})),
unit AS (SELECT r, row_number() OVER () AS u, u.whole AS whole, u.t AS t FROM cut),
tf AS (SELECT r, u, whole, term, count(*) * coalesce(any_value(idf), {license.UNKNOWN_IDF}) AS w FROM (SELECT r, u, whole, unnest({terms('t')}) AS term FROM unit) LEFT JOIN idf USING (term) GROUP BY r, u, whole, term),
score AS (SELECT r, license, template, whole, round(dot / n, 6) AS score FROM (SELECT r, u, whole, template, license, sum(w * tw) AS dot FROM tf JOIN tn USING (term) GROUP BY ALL) JOIN (SELECT u, sqrt(sum(w * w)) AS n FROM tf GROUP BY u) USING (u)
          UNION ALL SELECT r, regexp_extract(t, {quote(license.SPDX)}, 1), -1, false, 1.0 FROM unit WHERE regexp_matches(t, {quote(license.SPDX)})),
own AS (SELECT r, arg_max(license, score * 1000 - template / 1000000) AS license, max(score) AS score, CAST(NULL AS VARCHAR) AS whole_license FROM score WHERE score >= {license.MIN_SCORE} GROUP BY r),
named AS (SELECT d.r, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, score, whole_license, license IS NOT NULL AND (whole_license IS NOT NULL OR regexp_matches(path, {quote(license.FILE_NAME)})) AS is_file FROM d LEFT JOIN own USING (r)),
holder AS (SELECT dir AS above, coalesce(whole_license, license) AS h_license, doc_id AS h_from, score AS h_score FROM named WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) = 1),
near AS (SELECT n.r, h.* FROM named n JOIN holder h ON h.above = '' OR n.dir = h.above OR starts_with(n.dir, h.above || '/') WHERE n.license IS NULL QUALIFY row_number() OVER (PARTITION BY n.r ORDER BY length(h.above) DESC) = 1)
SELECT doc_id, path, coalesce(license, h_license) AS license, coalesce(score, h_score) AS score,
       CASE WHEN is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN h_from IS NOT NULL THEN 'inherited' END AS origin, h_from AS inherited_from
FROM named LEFT JOIN near USING (r)
"""


def pii_sql() -> str:
    """Positions from the lengths of matches and of the gaps between them.

    DuckDB's expressions have no look-around: word borders stand in for it, which differ only beside
    underscores; possessive quantifiers and the anchor before them change no match and are left out.
    """
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT) ELSE 2 * CAST(substr({digits}, i, 1) AS INT) - CASE WHEN CAST(substr({digits}, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    mod97 = f"CAST(list_aggregate(list_transform(string_split(substr({bare}, 5) || left({bare}, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '') AS HUGEINT) % 97 = 1"
    check = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda q: NOT regexp_matches(q, '^0*(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END", "phone": f"length({digits}) BETWEEN 10 AND 15", "iban": mod97,
        "ssn": f"NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000') AND regexp_matches(right(p, {pii.CONTEXT_CHARS}), '(?i)\\bssn\\b|social security')",
    }
    parts = []
    for rank, kind in enumerate(pii.KINDS):
        e = plain[kind.name]
        parts.append(
            f"SELECT r, {rank} AS rank, '{kind.name}' AS kind, s, s + length(m) AS e FROM (SELECT r, ms[k] AS m, ps[k] AS p, CAST(coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s"
            f" FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT r, regexp_extract_all(t, '{e}') AS ms, regexp_split_to_array(t, '{e}') AS ps FROM d))) WHERE {check[kind.name]}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS)
    n_base = sum(k.base for k in pii.KINDS)
    zero = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {n_base}) AS base FROM s GROUP BY r)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC, "op6_quality": quality_sql(), "op7_pq": PQ, "op9_pii": pii_sql(), "op10_license": license_sql()}
