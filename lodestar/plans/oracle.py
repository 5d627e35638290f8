"""Building blocks of the DuckDB SQL that queries are compared with."""

from __future__ import annotations

from ..functions import text as T

_LIST = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens(name: str, source: str, key: str, text: str, stop: bool = False) -> str:
    """CTEs that end in ``name`` (key, term): search tokens of ``source``, repeats kept."""
    stem = "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:-4] WHEN length(t) > 4 AND t LIKE '%ed' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"
    kept = f"length(t) >= 2 AND t NOT IN ({_LIST})" if stop else "length(t) >= 2"
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM {source}),
{name}_p AS (SELECT {key}, w, lower(w) AS low, list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1~\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS p FROM {name}_w),
{name}_t AS (SELECT {key}, unnest(CASE WHEN len(p) > 1 OR contains(w, '_') THEN list_concat([low], list_filter(p, lambda x: x <> low)) ELSE [low] END) AS t FROM {name}_p),
{name}_s AS (SELECT {key}, {stem} AS b FROM {name}_t WHERE {kept}),
{name} AS (SELECT {key}, CASE WHEN length(b) > 4 AND b LIKE '%e' THEN b[:-2] ELSE b END AS term FROM {name}_s)"""


def hashing(name: str, source: str, key: str, text: str, size: int = 1024) -> str:
    """CTEs that end in ``name`` (key, bucket, w): the hashing embedder's entries."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM {source}),
{name}_t AS (SELECT {key}, unnest(list_concat([lower(w)], list_filter(list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1~\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1))) AS t FROM {name}_w),
{name}_h AS (SELECT {key}, ('0x' || substr(md5(t), 30, 3))::INTEGER % {size} AS bucket, CASE WHEN ('0x' || substr(md5(t), 16, 1))::INTEGER % 2 = 1 THEN 1 ELSE -1 END AS sign FROM {name}_t),
{name}_v AS (SELECT {key}, bucket, sum(sign)::DOUBLE AS v FROM {name}_h GROUP BY ALL HAVING sum(sign) <> 0),
{name}_d AS (SELECT {key}, bucket, sign(v) * ln(1 + abs(v)) AS w FROM {name}_v),
{name} AS (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_d)"""


def bm25(name: str, doc_tokens: str, query_tokens: str, docs: str, doc: str = "doc", qid: str = "qid") -> str:
    """CTEs that end in ``name`` (qid, doc, score); ``docs`` names every document."""
    return f"""{name}_tf AS (SELECT {doc}, term, count(*) AS tf FROM {doc_tokens} GROUP BY ALL),
{name}_dl AS (SELECT d.{doc}, count(t.term) AS dl FROM {docs} d LEFT JOIN {doc_tokens} t ON t.{doc} = d.{doc} GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_dl),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT DISTINCT {qid}, term FROM {query_tokens}),
{name} AS (SELECT {qid}, {doc}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term) JOIN {name}_dl USING ({doc}) CROSS JOIN {name}_n GROUP BY ALL)"""


def top(name: str, scores: str, k: int, doc: str = "doc", qid: str = "qid") -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {doc}) AS rank FROM {scores}),
{name} AS (SELECT * FROM {name}_r WHERE rank <= {k})"""


def rrf(name: str, lists: str, k: int = 60) -> str:
    """CTEs that end in ``name`` (qid, doc, score, rank) from ``lists`` (qid, list_no, doc, rank, weight)."""
    return f"""{name}_f AS (SELECT qid, doc, round(sum(weight / ({k} + rank)::DOUBLE), 12) AS score, min(list_no * 100000 + rank) AS seen FROM {lists} GROUP BY ALL),
{name} AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc) AS rank FROM {name}_f)"""
