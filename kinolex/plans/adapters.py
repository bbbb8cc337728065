"""SQL of the adapter views, for the queries' equivalents."""

ITEMS = """items AS (
  SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_brand AS maker, p.p_type AS genre, CAST(1970 + p.p_size AS INTEGER) AS year,
         CAST(coalesce(n.cnt, 0) AS BIGINT) AS popularity, p.p_retailprice AS quality
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1) n ON n.l_partkey = p.p_partkey)"""
PROF = """prof AS (
  SELECT profile_id, item_id, rating FROM (
    SELECT user_id AS profile_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           CAST(CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'click' THEN 4.0 WHEN 'view' THEN 3.5 WHEN 'signup' THEN 3.0 ELSE 1.0 END AS DOUBLE) AS rating,
           row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1)"""
TAGS = """tags AS (
  SELECT vec_id AS item_id, concat('d', CAST(pos - 1 AS VARCHAR)) AS tag, round(CAST(x AS DOUBLE), 4) AS score
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) WHERE CAST(x AS DOUBLE) >= 0.15)"""
CREDITS = "credits AS (SELECT l_orderkey AS film_id, l_linenumber AS ordering, l_suppkey AS person_id FROM lineitem)"
VECS = "vecs AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label AS genre FROM embeddings)"


def with_(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"
