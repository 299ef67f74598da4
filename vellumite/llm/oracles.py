"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from vellumite.llm import quality
from vellumite.llm.queries import URL_RULES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules() -> str:
    rows = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    return f"(VALUES {rows}) AS r(rule, h, p, verdict)"


def _parts(url: str) -> str:
    known = f"{url} IS NOT NULL AND instr({url}, '://') > 0"
    rest = f"CASE WHEN {known} THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    raw = f"regexp_extract({rest}, '(?s)^[^/?#]*')"
    return f"{_LOW.format(raw)} AS host, regexp_extract(substr({rest}, length({raw}) + 1), '(?s)^[^?#]*') AS path"


def _without_dots(path: str) -> str:
    steps = f"string_split({path}, '/')"
    folded = f"list_reduce(list_prepend('', {steps}[2:]), lambda o, x: CASE WHEN x = '.' THEN o WHEN x = '..' THEN regexp_replace(o, '/[^/]*$', '') ELSE o || '/' || x END) || CASE WHEN {steps}[-1] IN ('.', '..') THEN '/' ELSE '' END"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN coalesce(nullif({folded}, ''), '/') ELSE {path} END"


def _address(url: str) -> str:
    """Scheme, host in lower case, and the rest without its fragment and dot steps; null without a host."""
    scheme, after = f"{_LOW.format(f"split_part({url}, '://', 1)")}", f"substr({url}, instr({url}, '://') + 3)"
    host = f"regexp_extract({after}, '(?s)^[^/?#]*')"
    rest = f"regexp_extract(substr({after}, length({host}) + 1), '(?s)^[^#]*')"
    path = f"regexp_extract({rest}, '(?s)^[^?]*')"
    return f"CASE WHEN instr({url}, '://') > 0 AND {host} <> '' THEN {scheme} || '://' || {_LOW.format(host)} || {_without_dots(path)} || substr({rest}, length({path}) + 1) END"


def url_filter() -> str:
    """The links are closed transitively, both ways; their ends have rules of their own."""
    fit = f"(SELECT max({{'n': length(rule), 'rule': rule, 'verdict': r.verdict}}) FROM {_rules()} WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"
    return f"""
      WITH RECURSIVE tags AS (
        SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?\\s*canonical\\b[^>]*>')) AS l, CAST(NULL AS VARCHAR) AS m FROM pages
        UNION ALL SELECT url, CAST(NULL AS VARCHAR), unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b[^>]*>')) FROM pages),
      hrefs AS (
        SELECT url, replace(trim(href, ' '), '&amp;', '&') AS href FROM (
          SELECT url, coalesce(nullif(regexp_extract(l, '(?is)\\bhref\\s*=\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(l, '(?is)\\bhref\\s*=\\s*''([^'']*)''', 1), ''), regexp_extract(l, '(?is)\\bhref\\s*=\\s*([^\\s>"'']+)', 1)) AS href FROM tags
          UNION ALL SELECT url, regexp_extract(m, '(?is)\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1) FROM tags) WHERE href <> ''),
      placed AS (SELECT *, {_parts("url")} FROM hrefs),
      ends AS (SELECT {_address("url")} AS a, {_address("dest")} AS b FROM (
        SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href
          WHEN starts_with(href, '/') THEN split_part(url, '://', 1) || '://' || host || href WHEN starts_with(href, '?') THEN split_part(url, '://', 1) || '://' || host || path || href ELSE split_part(url, '://', 1) || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || href END AS dest FROM placed)),
      edges AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
      reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
      nodes AS (SELECT b AS node, {_parts("b")} FROM (SELECT DISTINCT b FROM reach)),
      own AS (SELECT node, {fit}.verdict AS v FROM nodes),
      via AS (SELECT a AS node, CASE WHEN bool_or(coalesce(v, '') = 'allow') THEN 'allow' WHEN bool_or(coalesce(v, '') = 'block') THEN 'block' END AS v FROM reach JOIN own ON own.node = b GROUP BY a),
      judged AS (SELECT page_id, url, host, path, {fit} AS f FROM (SELECT page_id, url, {_parts("url")} FROM pages))
      SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, via.v, 'allow') AS verdict, CASE WHEN f IS NOT NULL THEN 'rule' WHEN via.v IS NOT NULL THEN 'link' ELSE 'default' END AS via
      FROM judged LEFT JOIN via ON via.node = {_address("url")}"""


def quality_rules(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    refused = ["(" + " OR ".join(f"coalesce({_double(r.measure)} * {r.sign} > {float(r.cutoffs[i])} * {r.sign}, false)" for r in quality.RULES) + ")" for i in range(quality.levels(quality.RULES))]
    tests = " UNION ALL ".join(f"SELECT stratum, {i} AS level, n, k{i} AS k FROM counted" for i in range(len(refused)))
    sums = ", ".join(f"sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS k{i}" for i, x in enumerate(refused))
    crossed = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(refused))
    return f"""
      WITH w AS (SELECT rowid AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
      g AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
      d AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
      c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM d) GROUP BY r),
      l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
      m AS (SELECT w.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
      b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
      counted AS (SELECT lang AS stratum, count(*) AS n, {sums} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
      tests AS ({tests}),
      passed AS (SELECT *, CASE WHEN k >= n * {alpha!r} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) END <= {delta!r} * n / (SELECT sum(n) FROM counted) AS ok FROM tests),
      certified AS (SELECT stratum, max(level) AS level FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY level) AS so_far FROM passed) WHERE so_far GROUP BY stratum)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(CASE c.level {crossed} END, false) AS kept
      FROM b LEFT JOIN certified c ON b.lang IS NOT DISTINCT FROM c.stratum"""


def _double(measure: str) -> str:
    """Spark's / divides doubles; so does DuckDB's, but a document without words gives null there too."""
    top, _, bottom = measure.partition(" / ")
    return f"(CAST({top} AS DOUBLE) / nullif({bottom}, 0))"


def lm_score(discount: float = 0.75) -> str:
    """Bigram counts of all and of good documents, less each document's own."""

    def chance(c: str, total: str, kinds: str, single: str, every: str, own: str) -> str:
        """-ln p of a bigram; `own` multiplies what the document itself has: 1 or 0."""
        one = f"(({single} - {own} * sd + 1) / ({every} - {own} * len + v))"
        many = f"({total} - {own} * nd)"
        return f"-ln(CASE WHEN {many} > 0 THEN greatest({c} - {own} * cd - {discount}, 0) / {many} + {discount} * ({kinds} - {own} * lost_{c}) / {many} * {one} ELSE {one} END)"

    return f"""
      WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      d AS (SELECT r, doc_id, w, len(w) AS len, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 1 ELSE 0 END AS g FROM t),
      k AS (SELECT r, g, len, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS a, w[i] AS b FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM d)),
      own AS (SELECT r, g, len, a, b, CAST(count(*) AS DOUBLE) AS cd FROM k GROUP BY ALL),
      cells AS (SELECT a, b, sum(cd) AS cn, sum(cd * g) AS cm FROM own GROUP BY a, b),
      contexts AS (SELECT a, sum(cn) AS tn, count(*) AS kn, sum(cm) AS tm, count(*) FILTER (cm > 0) AS km FROM cells GROUP BY a),
      ones AS (SELECT b, sum(cn) AS sn, sum(cm) AS sm FROM cells GROUP BY b),
      totals AS (SELECT sum(sn) AS en, sum(sm) AS em, count(*) + 1 AS v FROM ones),
      met AS (SELECT own.*, cn, cm, tn, kn, tm, km, sn, sm, en, em, v, sum(cd) OVER (PARTITION BY r, a) AS nd, sum(cd) OVER (PARTITION BY r, b) AS sd,
          sum(CASE WHEN cn = cd THEN 1 ELSE 0 END) OVER (PARTITION BY r, a) AS lost_cn, sum(CASE WHEN g = 1 AND cm = cd THEN 1 ELSE 0 END) OVER (PARTITION BY r, a) AS lost_cm
        FROM own JOIN cells USING (a, b) JOIN contexts USING (a) JOIN ones USING (b) CROSS JOIN totals),
      sums AS (SELECT r, sum(cd * {chance("cm", "tm", "km", "sm", "em", "g")}) AS x, sum(cd * {chance("cn", "tn", "kn", "sn", "en", "1")}) AS y FROM met GROUP BY r)
      SELECT doc_id, CAST(len AS BIGINT) AS n_tokens, round(x / len, 6) AS target_loss, round(y / len, 6) AS background_loss, round((x - y) / len, 6) AS score FROM d LEFT JOIN sums USING (r)"""


def nearest(k: int = 20) -> str:
    """Exact search: the same rows wherever the operator's recall is 1, as on the small tables."""
    return f"""
      WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
