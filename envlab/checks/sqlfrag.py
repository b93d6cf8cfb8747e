"""Reusable DuckDB SQL fragments: the seeded draw and the fixture views of FIXTURES.md."""
from __future__ import annotations


def draw(seed: int, tag: str, *keys: str) -> str:
    """DuckDB form of :func:`envlab.functions.draws.draw` (identical values)."""
    parts = ", ".join([f"'{int(seed)}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


BIOS = """bios AS (
  SELECT doc_id AS example_id, text, source AS profession, CAST(n_chars % 2 AS INTEGER) AS gender,
         CASE WHEN (doc_id // 20) % 10 < 7 THEN 'train' WHEN (doc_id // 20) % 10 = 7 THEN 'dev' ELSE 'test' END AS split
  FROM documents)"""

BIOS_STR = """bios_str AS (
  SELECT b.example_id, b.text, b.profession, b.split,
         CASE WHEN l.toxic = 1 THEN 'female' ELSE 'male' END AS gender
  FROM bios b JOIN labels l ON b.example_id = l.doc_id)"""


def head_logits(n_envs: int = 3, n_classes: int = 10, binary: bool = False, name: str = "head_logits") -> str:
    label = "(label % 2)" if binary else "label"
    c_n = 2 if binary else n_classes
    return f"""{name} AS (
  SELECT vec_id AS example_id, 'env_' || CAST(e + 1 AS VARCHAR) AS env,
         list_transform(range(0, {c_n}), lambda c: 4.0::DOUBLE * CAST(embedding[((3 * c + e) % 64) + 1] AS DOUBLE)
             + CASE WHEN c = lbl AND vec_id % 3 <> 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS logits,
         lbl AS label
  FROM (SELECT vec_id, embedding, CAST({label} AS INTEGER) AS lbl FROM embeddings) t,
       (SELECT range AS e FROM range(0, {n_envs})) envs)"""


HEAD_WEIGHTS = """head_weights AS (
  SELECT vec_id // 3 AS step, 'env_' || CAST(vec_id % 3 + 1 AS VARCHAR) AS env,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w
  FROM embeddings)"""

EVENT_STEPS = """event_steps AS (
  SELECT event_id, ts, user_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
  FROM events)"""

RUN_HISTORY = EVENT_STEPS + """,
run_history AS (
  SELECT user_id AS run_id, CASE WHEN user_id % 17 = 0 THEN 'baseline-' || CAST(user_id AS VARCHAR) ELSE
           'eval-' || (['elm','ilm','ilmg'])[user_id % 3 + 1] || '-lr_' || (['1e-3','5e-4','1e-4'])[(user_id // 3) % 3 + 1]
           || CASE WHEN user_id % 13 = 5 THEN '-seed-' || CAST(user_id % 5 AS VARCHAR)
                   WHEN user_id % 7 = 3 THEN '-seed' || CAST(user_id % 5 AS VARCHAR)
                   ELSE '-seed_' || CAST(user_id % 5 AS VARCHAR) END
           || CASE WHEN user_id % 5 = 2 THEN '-model ' || CAST((5000 * (user_id % 4 + 1)) // 1000 AS VARCHAR) || ' 000'
                   ELSE '-model-' || CAST(5000 * (user_id % 4 + 1) AS VARCHAR) END
         END AS run_name,
         step, 'ood_perplexity' AS metric,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
  FROM event_steps)"""

TRAIN_LOG = EVENT_STEPS + """,
train_log AS (SELECT user_id AS run, step, value AS train_loss FROM event_steps)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
