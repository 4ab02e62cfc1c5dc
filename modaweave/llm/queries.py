"""The queries of this folder: name to function of (spark, folder), and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op10_urls
from .common import table
from .op1_secrets import op1
from .op2_language import op2
from .op3_embedding import op3
from .op4_packing import op4
from .op5_quality import op5
from .op6_rules import op6
from .op7_minhash import op7
from .op8_mixing import op8
from .op9_licenses import op9
from .op10_urls import op10
from .op11_alignment import op11
from .op12_bestfit import op12
from .op13_conversations import op13

Run = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_batches(spark: SparkSession) -> None:
    """Few enough rows in an Arrow batch for very long texts to fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _on_documents(run: Callable[..., DataFrame], *others: str, **settings) -> Run:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return run(table(spark, sf_dir, "documents"), *[table(spark, sf_dir, t) for t in others], **settings)

    return query


QUERIES: dict[str, Run] = {
    "op1_secrets": _on_documents(op1),
    "op2_language": _on_documents(op2),
    "op3_embedding": lambda spark, sf_dir: op3(table(spark, sf_dir, "embeddings")),
    "op4_packing": lambda spark, sf_dir: _on_documents(op4, tokenizer=tokenizer())(spark, sf_dir),
    "op5_quality": _on_documents(op5, "labels"),
    "op6_rules": _on_documents(op6, "labels"),
    "op7_minhash": _on_documents(op7),
    "op8_mixing": _on_documents(op8),
    "op9_licenses": _on_documents(op9),
    "op10_urls": lambda spark, sf_dir: op10(table(spark, sf_dir, "pages")),
    "op11_alignment": lambda spark, sf_dir: _on_documents(op11, a_path=tokenizer("byte_bpe_50k.json"), b_path=tokenizer("piece_bpe_32k.model"))(spark, sf_dir),
    "op12_bestfit": lambda spark, sf_dir: _on_documents(op12, tokenizer=tokenizer("byte_bpe_50k.json"))(spark, sf_dir),
    "op13_conversations": lambda spark, sf_dir: op13(table(spark, sf_dir, "conversations")),
}

_LINKED = """
WITH RECURSIVE vec AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

_COPIES = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s
  FROM word
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT c.a, c.b FROM common c JOIN size x ON x.doc_id = c.a JOIN size y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN size z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

_REPAIRS = r"""
WITH RECURSIVE raw AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS k
  FROM conversations
), damaged AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE k <> 0
), placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), checked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS b
  FROM placed
), fault AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT (blank OR again) THEN 5 ELSE 0 END AS extra FROM checked),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (b IS NOT NULL AND b || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM fault GROUP BY c
), way(c, i, s, best) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), 'Z', {'cost': 0, 'audit': ''} FROM raw
  UNION ALL
  SELECT c, i, s, min({'cost': cost, 'audit': audit}) FROM (
    SELECT w.c, f.i, unnest([
        {'s': w.s, 'cost': w.best.cost + 2, 'audit': w.best.audit || 'D', 'ok': true},
        {'s': CASE WHEN w.s = 'a' THEN 'u' ELSE 'a' END, 'cost': w.best.cost + f.extra + CASE WHEN f.r = CASE WHEN w.s = 'a' THEN 'a' ELSE 'u' END THEN 0 ELSE 1 END,
         'audit': w.best.audit || CASE WHEN f.r = CASE WHEN w.s = 'a' THEN 'a' ELSE 'u' END THEN 'K' ELSE 'R' END, 'ok': NOT f.gone},
        {'s': CASE WHEN w.s = 'a' THEN 'a' ELSE 'u' END, 'cost': w.best.cost + 5 + f.extra + CASE WHEN f.r = CASE WHEN w.s = 'a' THEN 'u' ELSE 'a' END THEN 0 ELSE 1 END,
         'audit': w.best.audit || 'I' || CASE WHEN f.r = CASE WHEN w.s = 'a' THEN 'u' ELSE 'a' END THEN 'K' ELSE 'R' END, 'ok': NOT f.gone},
        {'s': 'S', 'cost': w.best.cost + f.extra, 'audit': w.best.audit || 'K', 'ok': NOT f.gone AND w.s = 'Z' AND f.r = 's'}], recursive := true)
    FROM way w JOIN fault f ON f.c = w.c AND f.i = w.i + 1)
  WHERE ok GROUP BY c, i, s
), done AS (
  SELECT w.c, min(CASE w.s WHEN 'a' THEN {'cost': w.best.cost + 5, 'audit': w.best.audit || 'I'} WHEN 'S' THEN {'cost': w.best.cost + 10, 'audit': w.best.audit || 'II'} ELSE w.best END) AS best
  FROM way w LEFT JOIN counted n ON n.c = w.c WHERE w.i = coalesce(n.n, 0) GROUP BY w.c
), edit AS (
  SELECT c, p, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY c ORDER BY p) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY c ORDER BY p) AS l
  FROM (SELECT c, p, substr(best.audit, p, 1) AS e FROM (SELECT c, best, unnest(range(1, length(best.audit) + 1)) AS p FROM done))
), told AS (
  SELECT e.c, e.p, e.e, e.l, f.role, coalesce(f.text, '') AS text, max(CASE WHEN e.l = 1 AND e.e = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.c) AS led
  FROM edit e LEFT JOIN fault f ON f.c = e.c AND f.i = e.i AND e.e <> 'I'
), line AS (
  SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (l - 1 - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM told WHERE e <> 'D' GROUP BY c
)
SELECT CAST(nullif(d.c, 'none') AS BIGINT) AS conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(d.best.cost AS BIGINT) AS cost, d.best.audit AS audit, sha256(coalesce(w.whole, '')) AS repaired_sha256
FROM done d LEFT JOIN counted n ON n.c = d.c LEFT JOIN line w ON w.c = d.c
"""

def _urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in op10_urls.RULES)
    parts = ", ".join(f"'{p}'" for p in op10_urls.BLOCKED_PARTS)
    start, rounds = 1 - op10_urls.FOLLOW, op10_urls.enough_rounds()
    node = lambda h: f"lower(regexp_replace({h}, '^.*@|:[0-9]*$', '', 'g'))"
    host = "translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE rule(verdict, rh, rp) AS (VALUES {rules}),
page AS (SELECT page_id, html, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
link AS (SELECT src, dst, count(*) AS n FROM (
    SELECT {node('host')} AS src, {node('d')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{op10_urls.ANCHOR.replace("'", "''")}', 1)) AS d FROM page))
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
node AS (SELECT {node('host')} AS host FROM page UNION SELECT src FROM link UNION SELECT dst FROM link),
fit AS (SELECT h.host, r.*, r.rh || r.rp AS rule FROM (SELECT host FROM node UNION SELECT host FROM page) h JOIN rule r ON h.host = r.rh OR ends_with(h.host, '.' || r.rh)),
whole AS (SELECT host, first(verdict ORDER BY length(rule) DESC, length(rh) DESC, rule) AS verdict FROM fit WHERE rp = '/' GROUP BY host),
seed AS (
  SELECT n.host, coalesce(w.verdict = 'block', false) OR list_has_any(regexp_split_to_array(n.host, '[.\\-_]'), [{parts}]) AS bad, coalesce(w.verdict = 'allow', false) AS good
  FROM node n LEFT JOIN whole w ON w.host = n.host),
start AS (SELECT host, 1 AS kind, {start} AS mass FROM seed WHERE bad UNION ALL SELECT host, 0, {start} FROM seed WHERE good AND NOT bad),
way AS (
  SELECT src AS f, dst AS t, 0 AS kind, n / sum(n) OVER (PARTITION BY src) AS share FROM link
  UNION ALL SELECT dst, src, 1, n / sum(n) OVER (PARTITION BY dst) FROM link),
state(k, host, kind, mass) AS (
  SELECT 0, host, kind, mass FROM start
  UNION ALL
  SELECT k + 1, host, kind, sum(mass) FROM (
    SELECT x.k, s.host, s.kind, s.mass FROM (SELECT DISTINCT k FROM state) x, start s
    UNION ALL SELECT a.k, w.t, a.kind, a.mass * w.share * {op10_urls.FOLLOW} FROM state a JOIN way w ON w.f = a.host AND w.kind = a.kind)
  WHERE k < {rounds} GROUP BY ALL),
mass AS (SELECT host, sum(CASE WHEN kind = 0 THEN mass ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN mass ELSE 0 END) AS distrust FROM state WHERE k = {rounds} GROUP BY host)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN m.distrust > m.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM page p LEFT JOIN mass m ON m.host = {node('p.host')}
LEFT JOIN (
  SELECT page_id, first(rule ORDER BY length(rule) DESC, length(rh) DESC, rule) AS rule, first(verdict ORDER BY length(rule) DESC, length(rh) DESC, rule) AS verdict
  FROM page JOIN fit USING (host) WHERE starts_with(path, rp) GROUP BY page_id) b USING (page_id)
"""


SQL: dict[str, str] = {"op3_embedding": _LINKED, "op7_minhash": _COPIES, "op10_urls": _urls(), "op13_conversations": _REPAIRS}
