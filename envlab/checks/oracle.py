"""DuckDB SQL twins of the registered queries (same column names, same parameters)."""
from __future__ import annotations

from envlab.checks.sqlfrag import BIOS, BIOS_STR, draw, with_
from envlab.plans.registry import K_TEST, MIN_TRAIN, MIN_VAL, SEED

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- support report (C4)
_SUPPORT = with_(
    BIOS,
    """tr AS (SELECT profession, 2 * least(count_if(gender = 0), count_if(gender = 1)) AS n
          FROM bios WHERE split IN ('train', 'dev') GROUP BY profession)""",
    """va AS (SELECT profession, 2 * least(count_if(gender = 0), count_if(gender = 1)) AS n
          FROM bios WHERE split = 'test' GROUP BY profession)""",
    """report AS (SELECT tr.profession, CAST(tr.n AS BIGINT) AS train_count, CAST(coalesce(va.n, 0) AS BIGINT) AS val_count
          FROM tr LEFT JOIN va ON tr.profession = va.profession WHERE tr.n > 0)""",
)
SQL["support_report"] = _SUPPORT + "SELECT * FROM report"
SQL["support_thresholds"] = _SUPPORT + f"""SELECT count(*) AS n_classes,
  CAST(count_if(train_count < {MIN_TRAIN}) AS BIGINT) AS n_low_train,
  CAST(count_if(val_count < {MIN_VAL}) AS BIGINT) AS n_low_val FROM report"""
SQL["support_top10"] = _SUPPORT + "SELECT * FROM report ORDER BY val_count DESC, profession ASC LIMIT 10"
SQL["support_bottom10"] = _SUPPORT + "SELECT * FROM report ORDER BY val_count ASC, profession ASC LIMIT 10"


# ---------------------------------------------------------------- balancing and splitting
def _balanced(src: str, name: str, where: str = "TRUE") -> str:
    return f"""{name}_x AS (SELECT *, {draw(SEED, 'bal', 'example_id')} AS d FROM {src} WHERE gender IN (0, 1) AND {where}),
{name}_k AS (SELECT profession, least(count_if(gender = 0), count_if(gender = 1)) AS k FROM {name}_x GROUP BY profession),
{name}_r AS (SELECT x.*, row_number() OVER (PARTITION BY profession, gender ORDER BY d, example_id) AS rn FROM {name}_x x),
{name} AS (SELECT r.* EXCLUDE (rn, d) FROM {name}_r r JOIN {name}_k k ON r.profession = k.profession WHERE r.rn <= k.k)"""


SQL["balanced_sample"] = with_(BIOS, _balanced("bios", "bal", "split IN ('train', 'dev')")) + (
    "SELECT example_id, profession, gender FROM bal"
)
SQL["balanced_sample_strgender"] = with_(
    BIOS,
    BIOS_STR,
    """bs AS (SELECT example_id, text, profession, split,
           CASE lower(trim(gender)) WHEN 'male' THEN 0 WHEN 'female' THEN 1 END AS gender FROM bios_str)""",
    _balanced("bs", "bal"),
) + "SELECT example_id, profession, gender FROM bal"

_SPLIT = with_(
    BIOS,
    _balanced("bios", "pool"),
    f"""px AS (SELECT *, {draw(SEED, 'test', 'example_id')} AS dt FROM pool),
keff AS (SELECT least({K_TEST}, min(n)) AS k FROM (SELECT profession, count(*) AS n FROM pool GROUP BY profession)),
pr AS (SELECT px.*, row_number() OVER (PARTITION BY profession ORDER BY dt, example_id) AS rt FROM px)""",
)
SQL["split_test"] = _SPLIT + "SELECT example_id, profession, gender FROM pr WHERE rt <= (SELECT k FROM keff)"
SQL["split_train"] = _SPLIT + "SELECT example_id, profession, gender FROM pr WHERE rt > (SELECT k FROM keff)"


# ---------------------------------------------------------------- classes, environments, corpora
from envlab.functions.text import TARGET_TOKENS, WHITESPACE_RUN  # noqa: E402
from envlab.plans.registry import GAP, GAP_CLAMPED, LEGACY_P1, LEGACY_P2, LEGACY_VAL, M, M_CLAMPED, MEAN, VAL_COLOR  # noqa: E402

_TARGETS = ", ".join(f"'{t}'" for t in TARGET_TOKENS)


def _grid(gap: float, m: int, mean: float, val: float, name: str = "grid") -> str:
    return f"""{name} AS (
  SELECT CAST(j + 1 AS INTEGER) AS env,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, {mean}::DOUBLE + (-({gap}::DOUBLE / 2.0::DOUBLE) + CAST(j AS DOUBLE) * ({gap}::DOUBLE / {float(m - 1)}::DOUBLE)))) AS p_color
  FROM (SELECT range AS j FROM range(0, {m})) g),
{name}_full AS (
  SELECT env, p_color, 1.0::DOUBLE - p_color AS p_align FROM {name}
  UNION ALL SELECT 0, {val}::DOUBLE, 1.0::DOUBLE - {val}::DOUBLE)"""


_LEGACY_GRID = f"""grid_full AS (
  SELECT * FROM (VALUES (1, 1.0::DOUBLE - {LEGACY_P1}::DOUBLE, {LEGACY_P1}::DOUBLE), (2, 1.0::DOUBLE - {LEGACY_P2}::DOUBLE, {LEGACY_P2}::DOUBLE),
                        (0, 1.0::DOUBLE - {LEGACY_VAL}::DOUBLE, {LEGACY_VAL}::DOUBLE)) t(env, p_color, p_align))"""


def _classes(src: str) -> str:
    return f"""classes AS (
  SELECT profession, CAST(lbl AS INTEGER) AS label, CAST(CASE WHEN lbl < c // 2 THEN 0 ELSE 1 END AS INTEGER) AS grp
  FROM (SELECT profession, row_number() OVER (ORDER BY profession) - 1 AS lbl, count(*) OVER () AS c
        FROM (SELECT DISTINCT profession FROM {src})))"""


def _inject_sql(text: str, grp: str, p: str, key: str, seed: int = SEED) -> str:
    toks = f"list_filter(regexp_split_to_array({text}, '{WHITESPACE_RUN}'), lambda x: x <> '')"
    d = draw(seed, "inj", key, "i - 1")
    return (
        f"array_to_string(list_transform({toks}, lambda w, i: CASE WHEN lower(w) IN ({_TARGETS}) THEN "
        f"(CASE WHEN ({d} < {p}) = ({grp} = 0) THEN '<AAA> ' ELSE '<BBB> ' END) || w ELSE w END), ' ')"
    )


_TRAIN_A = _balanced("bios", "tra", "split IN ('train', 'dev')")
_TEST_A = _balanced("bios", "tea", "split = 'test'")
_CONTIG = f"""cx AS (SELECT *, {draw(SEED, 'shuf', 'example_id')} AS ds FROM tra),
contig AS (SELECT example_id, profession, text, gender,
             row_number() OVER (ORDER BY ds, example_id) - 1 AS shuffle_pos, count(*) OVER () AS n FROM cx),
envs_a AS (SELECT *, CAST(CASE WHEN n // {{m}} = 0 THEN {{m}} - 1 ELSE least(shuffle_pos // (n // {{m}}), {{m}} - 1) END + 1 AS INTEGER) AS env FROM contig)"""
_RR = f"""rx AS (SELECT *, {draw(SEED, 'env', 'example_id')} AS de FROM (SELECT * EXCLUDE (dt, rt) FROM pr WHERE rt > (SELECT k FROM keff))),
envs_b AS (SELECT example_id, profession, text, gender,
             CAST((row_number() OVER (PARTITION BY profession ORDER BY de, example_id) - 1) % {{m}} + 1 AS INTEGER) AS env FROM rx)"""

SQL["class_ids"] = with_(BIOS, _TRAIN_A, _classes("tra")) + "SELECT * FROM classes"


def _grid_counts(envs: str) -> str:
    return f"""SELECT g.env, round(g.p_color, 9) AS p_color, round(g.p_align, 9) AS p_align, CAST(coalesce(n.n, 0) AS BIGINT) AS n_rows
FROM grid_full g LEFT JOIN (SELECT env, count(*) AS n FROM {envs} GROUP BY env) n ON g.env = n.env"""


SQL["env_grid"] = with_(_SPLIT[len("WITH "):].rstrip(), _RR.format(m=M), _grid(GAP, M, MEAN, VAL_COLOR)) + _grid_counts("envs_b")
SQL["env_grid_clamped"] = with_(_SPLIT[len("WITH "):].rstrip(), _RR.format(m=M_CLAMPED), _grid(GAP_CLAMPED, M_CLAMPED, MEAN, VAL_COLOR)) + _grid_counts("envs_b")
SQL["env_grid_legacy"] = with_(BIOS, _TRAIN_A, _CONTIG.format(m=2), _LEGACY_GRID) + _grid_counts("envs_a")
SQL["envs_contiguous"] = with_(BIOS, _TRAIN_A, _CONTIG.format(m=M)) + "SELECT example_id, profession, env, shuffle_pos FROM envs_a"
SQL["envs_round_robin"] = with_(_SPLIT[len("WITH "):].rstrip(), _RR.format(m=M)) + "SELECT example_id, profession, env FROM envs_b"


def _lines_sql(envs: str, test: str, grid: str) -> str:
    inj = _inject_sql("r.text", "c.grp", "g.p_align", "r.example_id")
    return f"""lines AS (
  SELECT CASE WHEN r.env = 0 THEN 'val' ELSE 'env_' || CAST(r.env AS VARCHAR) END AS env, r.example_id,
         {inj} AS text, c.label AS labels
  FROM (SELECT example_id, profession, text, env FROM {envs}
        UNION ALL SELECT example_id, profession, text, 0 AS env FROM {test}) r
  JOIN classes c ON r.profession = c.profession JOIN {grid} g ON r.env = g.env)"""


_CORPUS_A = with_(BIOS, _TRAIN_A, _TEST_A, _CONTIG.format(m=M), _classes("tra"), _grid(GAP, M, MEAN, VAL_COLOR),
                  _lines_sql("envs_a", "tea", "grid_full"))
_CORPUS_A_LEGACY = with_(BIOS, _TRAIN_A, _TEST_A, _CONTIG.format(m=2), _classes("tra"), _LEGACY_GRID,
                         _lines_sql("envs_a", "tea", "grid_full"))
_TEST_B = "teb AS (SELECT * EXCLUDE (dt, rt) FROM pr WHERE rt <= (SELECT k FROM keff))"
_CORPUS_B = with_(_SPLIT[len("WITH "):].rstrip(), _RR.format(m=M), _TEST_B, _classes("envs_b"), _grid(GAP, M, MEAN, VAL_COLOR),
                  _lines_sql("envs_b", "teb", "grid_full"))
_MD5 = "SELECT env, example_id, labels, md5(text) AS text_md5 FROM lines"
SQL["corpus_a"] = _CORPUS_A + _MD5
SQL["corpus_a_legacy"] = _CORPUS_A_LEGACY + _MD5
SQL["corpus_b"] = _CORPUS_B + _MD5
SQL["corpus_b_pooled"] = _CORPUS_B + f"""SELECT row_number() OVER (ORDER BY {draw(SEED, 'erm', 'env', 'example_id')}, env, example_id) - 1 AS erm_pos,
  example_id, labels, md5(text) AS text_md5 FROM lines WHERE env <> 'val'"""
SQL["inject_tokens"] = _CORPUS_B + """SELECT env, labels, count(*) AS n_rows,
  CAST(sum(len(list_filter(regexp_split_to_array(text, ' '), lambda x: x = '<AAA>'))) AS BIGINT) AS n_aaa,
  CAST(sum(len(list_filter(regexp_split_to_array(text, ' '), lambda x: x = '<BBB>'))) AS BIGINT) AS n_bbb
FROM lines GROUP BY env, labels"""

_TOY_KEY = "CAST(env AS VARCHAR) || ':' || CAST(id AS VARCHAR)"
# ---------------------------------------------------------------- evaluation (C6) and head divergence
from envlab.checks.sqlfrag import HEAD_WEIGHTS, head_logits  # noqa: E402


def _ens(src: str = "head_logits", by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    gj = (lambda a, b: f"{a}.{by} = {b}.{by} AND ") if by else (lambda a, b: "")
    return f"""ex AS (SELECT {g}example_id, first(label) AS label, list(logits ORDER BY env) AS heads FROM {src} GROUP BY {g}example_id),
ens AS (
  SELECT {g}example_id, label, CAST(len(heads) AS INTEGER) AS n_heads,
         CASE WHEN len(heads) = 1 THEN heads[1] ELSE
           list_transform(range(1, len(heads[1]) + 1), lambda c: list_reduce(list_transform(heads, lambda h: h[c] / len(heads)), lambda a, b: a + b, 0.0::DOUBLE))
         END AS logits
  FROM ex),
pred AS (SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM ens),
conf AS (SELECT {g}label, pred, count(*) AS n, max(len(logits)) AS n_classes FROM pred GROUP BY {g}label, pred),
cls AS (SELECT {g}unnest(range(0, greatest(max(n_classes), max(label) + 1, max(pred) + 1))) AS class FROM conf {'GROUP BY ' + by if by else ''}),
sup AS (SELECT {g}label AS class, sum(n) AS n FROM conf GROUP BY ALL),
prd AS (SELECT {g}pred AS class, sum(n) AS n FROM conf GROUP BY ALL),
tpc AS (SELECT {g}label AS class, sum(n) AS n FROM conf WHERE label = pred GROUP BY ALL),
pc0 AS (
  SELECT {'c.' + by + ', ' if by else ''}CAST(c.class AS INTEGER) AS class, CAST(coalesce(s.n, 0) AS BIGINT) AS support,
         CAST(coalesce(p.n, 0) AS BIGINT) AS predicted, CAST(coalesce(t.n, 0) AS BIGINT) AS tp
  FROM cls c LEFT JOIN sup s ON {gj('c', 's')}c.class = s.class LEFT JOIN prd p ON {gj('c', 'p')}c.class = p.class
       LEFT JOIN tpc t ON {gj('c', 't')}c.class = t.class),
pc AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM pc0)"""


def _r9(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


def _report(by: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    p2 = f"{by}, " if by else ""
    return f"""rt AS (
  SELECT *, count(*) OVER ({part}) AS k, greatest(1, (count(*) OVER ({part})) // 4) AS q,
         row_number() OVER ({part}ORDER BY support, class) AS pos, support > 0 AS present,
         rank() OVER (PARTITION BY {p2}support > 0 ORDER BY support) + (count(*) OVER (PARTITION BY {p2}support > 0, support) - 1) / 2.0::DOUBLE AS rs,
         rank() OVER (PARTITION BY {p2}support > 0 ORDER BY f1) + (count(*) OVER (PARTITION BY {p2}support > 0, f1) - 1) / 2.0::DOUBLE AS rf
  FROM pc),
rep AS (
  SELECT {p2}sum(tp) / sum(support) AS accuracy,
         avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END) AS f1_macro,
         CASE WHEN count_if(present) >= 3 AND stddev_samp(CASE WHEN present THEN CAST(support AS DOUBLE) END) * stddev_samp(CASE WHEN present THEN f1 END) > 0
              THEN covar_samp(CASE WHEN present THEN CAST(support AS DOUBLE) END, CASE WHEN present THEN f1 END)
                   / (stddev_samp(CASE WHEN present THEN CAST(support AS DOUBLE) END) * stddev_samp(CASE WHEN present THEN f1 END)) END AS corr_support_f1_pearson_r,
         CASE WHEN count_if(present) >= 3 AND stddev_samp(CASE WHEN present THEN rs END) * stddev_samp(CASE WHEN present THEN rf END) > 0
              THEN covar_samp(CASE WHEN present THEN rs END, CASE WHEN present THEN rf END)
                   / (stddev_samp(CASE WHEN present THEN rs END) * stddev_samp(CASE WHEN present THEN rf END)) END AS corr_support_f1_spearman_rho,
         avg(CASE WHEN pos > k - q THEN f1 END) AS f1_head,
         avg(CASE WHEN pos <= q THEN f1 END) AS f1_tail
  FROM rt {'GROUP BY ' + by if by else ''})"""


_REPORT = _report()
_REPORT_COLS = ["accuracy", "f1_macro", "corr_support_f1_pearson_r", "corr_support_f1_spearman_rho", "f1_head", "f1_tail"]
_REPORT_SELECT = f"SELECT {_r9(_REPORT_COLS)}, round(f1_head - f1_tail, 9) AS gap_head_tail FROM rep"

SQL["ensemble_pred"] = with_(head_logits(), _ens()) + (
    "SELECT example_id, label, pred, n_heads, list_transform(logits, lambda x: round(x, 9)) AS logits FROM pred"
)
SQL["confusion"] = with_(head_logits(), _ens()) + "SELECT label, pred, n FROM conf"
SQL["per_class_f1"] = with_(head_logits(), _ens()) + (
    f"SELECT class, support, predicted, tp, {_r9(['precision', 'recall', 'f1'])} FROM pc"
)
SQL["eval_report"] = with_(head_logits(), _ens(), _REPORT) + _REPORT_SELECT
SQL["eval_report_binary"] = with_(head_logits(binary=True), _ens(), _REPORT) + _REPORT_SELECT
SQL["eval_report_single_head"] = with_(head_logits(n_envs=1), _ens(), _REPORT) + _REPORT_SELECT
SQL["eval_report_extended"] = with_(head_logits(), _ens()) + """SELECT
  round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy,
  round(sum(precision * support) / sum(support), 9) AS precision_weighted,
  round(sum(recall * support) / sum(support), 9) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 9) AS f1_weighted,
  round(min(recall), 9) AS worst_recall, arg_min(class, (recall, class)) AS worst_recall_cls,
  round(min(f1), 9) AS worst_f1, arg_min(class, (f1, class)) AS worst_f1_cls
FROM pc WHERE support > 0 OR predicted > 0"""
SQL["eval_loss"] = with_(head_logits(), _ens()) + """SELECT
  round(avg(list_max(logits) + ln(list_reduce(list_transform(logits, lambda x: exp(x - list_max(logits))), lambda a, b: a + b, 0.0::DOUBLE))
            - logits[label + 1]), 9) AS loss,
  count(*) AS n_examples FROM pred"""


def _softmax(h: str) -> str:
    return (f"list_transform({h}, lambda x: greatest(exp(x - list_max({h})) / "
            f"list_reduce(list_transform({h}, lambda y: exp(y - list_max({h}))), lambda a, b: a + b, 0.0::DOUBLE), 1e-12::DOUBLE))")


_JS = """list_reduce(list_transform(range(1, len(a.p) + 1), lambda i:
            0.5::DOUBLE * (a.p[i] * (ln(a.p[i]) - ln((a.p[i] + b.p[i]) * 0.5::DOUBLE)) + b.p[i] * (ln(b.p[i]) - ln((a.p[i] + b.p[i]) * 0.5::DOUBLE)))),
          lambda s, t: s + t, 0.0::DOUBLE)"""


def _pred_div(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gj = f"a.{group} = b.{group} AND " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""probs AS (SELECT {g}example_id, env, {_softmax('logits')} AS p FROM {src}),
pairs AS (
  SELECT {'a.' + group + ', ' if group else ''}a.example_id, {_JS} AS js,
         CAST(list_position(a.p, list_max(a.p)) <> list_position(b.p, list_max(b.p)) AS DOUBLE) AS dis
  FROM probs a JOIN probs b ON {gj}a.example_id = b.example_id AND a.env < b.env),
exs AS (SELECT DISTINCT {g}example_id FROM {src}),
per_ex AS (SELECT {'e.' + group + ', ' if group else ''}e.example_id, avg(js) AS js, avg(dis) AS dis
           FROM exs e LEFT JOIN pairs p ON {'e.' + group + ' = p.' + group + ' AND ' if group else ''}e.example_id = p.example_id
           GROUP BY ALL),
pos AS (SELECT *, row_number() OVER ({part}ORDER BY example_id) - 1 AS pos FROM per_ex),
bat AS (SELECT {g}pos // 64 AS batch, avg(js) AS js, avg(dis) AS dis FROM pos GROUP BY ALL),
div AS (SELECT {g}avg(js) AS js_mean, avg(dis) AS disagree_mean FROM bat {'GROUP BY ' + group if group else ''})"""


SQL["head_js"] = with_(head_logits(), _pred_div("head_logits")) + (
    "SELECT round(js_mean, 9) AS js_mean, round(disagree_mean, 9) AS disagree_mean FROM div"
)
SQL["head_js_single_head"] = with_(head_logits(n_envs=1), _pred_div("head_logits")) + (
    "SELECT round(js_mean, 9) AS js_mean, round(disagree_mean, 9) AS disagree_mean FROM div"
)
_WDIV = """wpairs AS (
  SELECT a.step,
         sqrt(list_reduce(list_transform(range(1, len(a.w) + 1), lambda i: (a.w[i] - b.w[i]) * (a.w[i] - b.w[i])), lambda s, t: s + t, 0.0::DOUBLE)) AS l2,
         1.0::DOUBLE - list_reduce(list_transform(range(1, len(a.w) + 1), lambda i:
             (a.w[i] / greatest(sqrt(list_reduce(list_transform(a.w, lambda x: x * x), lambda s, t: s + t, 0.0::DOUBLE)), 1e-12::DOUBLE))
           * (b.w[i] / greatest(sqrt(list_reduce(list_transform(b.w, lambda x: x * x), lambda s, t: s + t, 0.0::DOUBLE)), 1e-12::DOUBLE))),
           lambda s, t: s + t, 0.0::DOUBLE) AS cos
  FROM head_weights a JOIN head_weights b ON a.step = b.step AND a.env < b.env),
wdiv AS (SELECT s.step, avg(l2) AS l2_mean, avg(cos) AS cosine_mean FROM (SELECT DISTINCT step FROM head_weights) s
  LEFT JOIN wpairs p ON s.step = p.step GROUP BY s.step)"""
SQL["head_weight_divergence"] = with_(HEAD_WEIGHTS, _WDIV) + (
    "SELECT step, round(l2_mean, 9) AS l2_mean, round(cosine_mean, 9) AS cosine_mean FROM wdiv"
)
_STEP_LOGITS = """step_logits AS (
  SELECT step, env, CAST(k.range AS BIGINT) AS example_id, w[k.range * (len(w) // 8) + 1 : (k.range + 1) * (len(w) // 8)] AS logits
  FROM head_weights, range(0, 8) k)"""
SQL["heads_compact"] = with_(HEAD_WEIGHTS, _WDIV, _STEP_LOGITS, _pred_div("step_logits", "step")) + """SELECT
  coalesce(w.step, d.step) AS step, round(w.l2_mean, 9) AS l2_mean, round(w.cosine_mean, 9) AS cosine_mean,
  round(d.js_mean, 9) AS js_mean, round(d.disagree_mean, 9) AS disagree_mean
FROM wdiv w FULL JOIN div d ON w.step = d.step"""


# ---------------------------------------------------------------- run histories (C8) and the run grid
from envlab.checks.sqlfrag import RUN_HISTORY  # noqa: E402
from envlab.plans.registry import METRIC, PIVOT_LRS  # noqa: E402

_PARSE = r"""runs AS (SELECT DISTINCT run_id, run_name FROM run_history),
parsed0 AS (
  SELECT run_id, run_name,
    nullif(regexp_extract(s, '^eval[\-_ ]([a-z0-9]+)', 1), '') AS algo,
    coalesce(nullif(regexp_extract(s, 'lr[\-_ ]([0-9eE.+\-]+)[\-_ ]seed', 1), ''),
             nullif(regexp_extract(s, '^eval[\-_ ][a-z0-9]+[\-_ ]([0-9eE.+\-]+)[\-_ ]seed', 1), '')) AS lr,
    TRY_CAST(nullif(regexp_extract(s, 'seed_?([0-9]+)', 1), '') AS INTEGER) AS seed,
    TRY_CAST(nullif(regexp_replace(nullif(regexp_extract(s, 'model[\-_ ]([0-9 _]+)', 1), ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS model
  FROM (SELECT run_id, run_name, lower(trim(coalesce(run_name, ''))) AS s FROM runs)),
parsed AS (SELECT *, (algo IS NOT NULL AND lr IS NOT NULL AND seed IS NOT NULL AND model IS NOT NULL) AS parsed FROM parsed0),
summ AS (SELECT run_id, arg_max_null(value, step) AS sv, max(step) AS ss FROM run_history GROUP BY run_id)"""


def exact_mean(v: str) -> str:
    """The mean of doubles rounded once: values as integers times 2**-80 (exact from 2**-27 to 2**40), the
    quotient as an integer of some 57 bits whose last bit tells a rest."""
    total = f"sum(CAST({v} * pow(2.0, 80) AS HUGEINT))"
    cut = "CAST(x.a // (x.n * x.p) AS BIGINT)"
    odd = f"{cut} + CASE WHEN {cut} % 2 = 0 AND x.a % (x.n * x.p) <> 0 THEN 1 ELSE 0 END"
    power = f"greatest(0, CAST(floor(log2(greatest(CAST(abs({total}) // count({v}) AS DOUBLE), 1.0))) AS INTEGER) - 56)"
    one = f"{{'a': abs({total}), 'n': CAST(count({v}) AS HUGEINT), 'p': CAST(pow(2.0, {power}) AS HUGEINT), 'k': {power}, 's': sign({total})}}"
    mean = f"list_transform([{one}], lambda x: x.s * CAST({odd} AS DOUBLE) * pow(2.0, x.k - 80))[1]"
    return f"CASE WHEN count({v}) > 0 THEN {mean} END"


def _value(strategy: str) -> str:
    order = "step DESC" if strategy == "last" else "value ASC, step ASC"
    return f"""hvr AS (SELECT run_id, value, step, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS rn
        FROM run_history WHERE metric = '{METRIC}' AND value IS NOT NULL AND NOT isnan(value)),
vals AS (
  SELECT r.run_id, CASE WHEN h.value IS NOT NULL THEN h.step ELSE s.ss END AS step,
         CASE WHEN h.value IS NOT NULL THEN h.value ELSE s.sv END AS value
  FROM runs r LEFT JOIN (SELECT * FROM hvr WHERE rn = 1) h ON r.run_id = h.run_id LEFT JOIN summ s ON r.run_id = s.run_id),
kept AS (SELECT p.run_id, p.run_name, p.algo, p.lr, p.seed, p.model, v.step, v.value
         FROM parsed p JOIN vals v ON p.run_id = v.run_id WHERE p.parsed AND v.value IS NOT NULL)"""


_RUNS = with_(RUN_HISTORY[len(""):], _PARSE)
SQL["parse_runs"] = _RUNS + "SELECT * FROM parsed"
SQL["unparsed_runs"] = _RUNS + "SELECT run_id, run_name FROM parsed WHERE NOT parsed ORDER BY run_name, run_id"
SQL["run_last"] = with_(RUN_HISTORY, _PARSE, _value("last")) + "SELECT * FROM kept"
SQL["run_min"] = with_(RUN_HISTORY, _PARSE, _value("min")) + "SELECT * FROM kept"
SQL["run_totals"] = with_(RUN_HISTORY, _PARSE, _value("last")) + """SELECT count(*) AS n_runs, CAST(count_if(parsed) AS BIGINT) AS n_parsed,
  CAST(count_if(parsed AND run_id IN (SELECT run_id FROM kept)) AS BIGINT) AS n_kept,
  CAST(count_if(NOT parsed) AS BIGINT) AS n_unparsed FROM parsed"""
SQL["run_last_summary"] = with_(RUN_HISTORY, """h AS (SELECT run_id, arg_max_null(value, step) FILTER (value IS NOT NULL AND run_id % 7 <> 2) AS hv,
    max(step) FILTER (value IS NOT NULL AND run_id % 7 <> 2) AS hs, arg_max_null(value, step) AS sv, max(step) AS ss, any_value(run_name) AS run_name
  FROM run_history GROUP BY run_id)""") + """SELECT run_id, run_name, CASE WHEN hs IS NULL THEN ss ELSE hs END AS step, CASE WHEN hs IS NULL THEN sv ELSE hv END AS value
FROM h WHERE CASE WHEN hs IS NULL THEN sv ELSE hv END IS NOT NULL"""
SQL["run_totals_summary"] = with_(RUN_HISTORY, _PARSE, _value("last")) + """SELECT count(*) AS n_runs, CAST(count_if(parsed) AS BIGINT) AS n_parsed,
  CAST(count_if(parsed AND run_id % 7 <> 2 AND run_id IN (SELECT run_id FROM kept)) AS BIGINT) AS n_kept,
  CAST(count_if(NOT parsed) AS BIGINT) AS n_unparsed FROM parsed"""
_AGG = f"""agg AS (SELECT algo, lr, model, count(value) AS n_seeds, round({exact_mean('value')}, 9) AS mean_{METRIC},
             round(stddev_samp(value), 9) AS std_{METRIC} FROM kept GROUP BY algo, lr, model)"""
SQL["seed_aggregate"] = with_(RUN_HISTORY, _PARSE, _value("last"), _AGG) + "SELECT * FROM agg"
SQL["seed_pivot"] = with_(RUN_HISTORY, _PARSE, _value("last"), _AGG) + "SELECT algo, model, " + ", ".join(
    f"""max(CASE WHEN lr = '{x}' THEN mean_{METRIC} END) AS "{x}\"""" for x in PIVOT_LRS
) + " FROM agg GROUP BY algo, model"

EVAL_RUNS = """eval_runs AS (
  SELECT user_id, (['elm','ilm','ilmg'])[user_id % 3 + 1] AS algo, ([0.10, 0.20, 0.30, 0.40]::DOUBLE[])[(user_id // 3) % 4 + 1] AS gap,
         CASE WHEN user_id = 1 THEN '0.005' ELSE (['0.001','0.0005','0.0001'])[(user_id // 12) % 3 + 1] END AS lr,
         CAST(user_id % 5 AS INTEGER) AS seed,
         CASE WHEN user_id % 3 = 2 THEN ([1, 15, 30])[(user_id // 36) % 3 + 1] END AS k
  FROM (SELECT DISTINCT user_id FROM events))"""
SQL["run_grid"] = with_(EVAL_RUNS) + """SELECT r.user_id,
  r.algo || '_gap' || lpad(CAST(CAST(round(r.gap * 100) AS INTEGER) AS VARCHAR), 3, '0') || '_lr' || r.lr || '_seed' || CAST(r.seed AS VARCHAR)
    || '_steps' || CAST(e.n * 250 AS VARCHAR)
    || CASE WHEN r.k IS NULL THEN '' ELSE '_K' || CAST(r.k AS VARCHAR) || '_freeze' || CASE WHEN r.k = 1 THEN '1' ELSE '0' END END AS run_name,
  r.algo AS tag_algo, 'gap' || lpad(CAST(CAST(round(r.gap * 100) AS INTEGER) AS VARCHAR), 3, '0') AS tag_group,
  'K' || CAST(r.k AS VARCHAR) AS tag_k, CASE WHEN r.k IS NOT NULL THEN 'freeze' || CASE WHEN r.k = 1 THEN '1' ELSE '0' END END AS tag_freeze
FROM eval_runs r JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON r.user_id = e.user_id"""


# ---------------------------------------------------------------- learning curves
from envlab.checks.sqlfrag import EVENT_STEPS  # noqa: E402

_EVAL_ROWS = with_(EVENT_STEPS, EVAL_RUNS, """er0 AS (
  SELECT e.user_id, r.algo || '_gap' || lpad(CAST(CAST(round(r.gap * 100) AS INTEGER) AS VARCHAR), 3, '0') || '_lr' || r.lr
           || '_seed' || CAST(r.seed AS VARCHAR) AS run, TRY_CAST(r.lr AS DOUBLE) AS lr, e.step * 250 AS step,
         CASE WHEN e.user_id = 2 AND e.step = 0 THEN NULL ELSE e.value / 500.0::DOUBLE END AS accuracy,
         e.value / 600.0::DOUBLE AS f1_macro, e.value / 400.0::DOUBLE AS f1_head, e.value / 800.0::DOUBLE AS f1_tail,
         e.value / 400.0::DOUBLE - e.value / 800.0::DOUBLE AS gap_head_tail,
         CASE WHEN e.user_id % 2 = 0 THEN 1000.0::DOUBLE / (e.value + 1.0::DOUBLE) END AS loss
  FROM event_steps e JOIN eval_runs r ON e.user_id = r.user_id),
er AS (SELECT * FROM er0 UNION ALL SELECT * FROM (SELECT * FROM er0 WHERE user_id = 4 ORDER BY step DESC LIMIT 1))""")
_CM = ["accuracy", "f1_macro", "f1_head", "f1_tail", "gap_head_tail", "loss"]
SQL["ragged_logs"] = _EVAL_ROWS + f"SELECT run, lr, step, {_r9(_CM)} FROM er"


SQL["curve_summary"] = _EVAL_ROWS + "SELECT lr, step, " + ", ".join(
    f"round({exact_mean(m)}, 9) AS {m}, round(stddev_samp({m}), 9) AS {m}_std" for m in _CM
) + " FROM er WHERE lr IN (0.001, 0.0005, 0.0001) GROUP BY lr, step"


# ---------------------------------------------------------------- load, encode, batch
from envlab.functions.text import NON_WHITESPACE  # noqa: E402
from envlab.operators.encode import SPECIALS  # noqa: E402
from envlab.operators.curves import DEFAULT_METRICS  # noqa: E402
from envlab.plans.registry import ACCUM, BATCH, EPOCHS, EVAL_BATCHES, FIXED_LENGTH  # noqa: E402

_SPECIALS = ", ".join(f"'{s}'" for s in SPECIALS)
_WTOK = (f"list_transform(list_filter(regexp_split_to_array(text, '{WHITESPACE_RUN}'), lambda x: x <> ''), "
         f"lambda t: CASE WHEN t IN ({_SPECIALS}) THEN t ELSE lower(t) END)")
_VOCAB = f"""vtoks AS (SELECT unnest({_WTOK}) AS token FROM lines WHERE env <> 'val'),
vcnt AS (SELECT token, count(*) AS n FROM vtoks WHERE token NOT IN ({_SPECIALS}) GROUP BY token),
vtop AS (SELECT token, n FROM vcnt),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token ASC) - 1 + {len(SPECIALS)} AS INTEGER) AS id, n FROM vtop
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{s}', {i}, 0::BIGINT)" for i, s in enumerate(SPECIALS))}) t(token, id, n))"""
_ENC = f"""enc_in AS (SELECT env, example_id, labels, {_WTOK} AS toks
           FROM lines WHERE text IS NOT NULL AND regexp_matches(text, '{NON_WHITESPACE}')),
enc_u AS (SELECT env, example_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM enc_in),
enc_ids AS (SELECT u.env, u.example_id, list(coalesce(v.id, 1) ORDER BY u.pos) AS ids
            FROM enc_u u LEFT JOIN vocab v ON u.token = v.token GROUP BY u.env, u.example_id),
encoded AS (SELECT e.env, e.example_id, e.labels, [2] || coalesce(i.ids, []) || [3] AS input_ids
            FROM enc_in e LEFT JOIN enc_ids i ON e.env = i.env AND e.example_id = i.example_id),
encoded2 AS (SELECT *, list_transform(input_ids, lambda x: 1) AS attention_mask FROM encoded)"""
_BAT = f"""bat AS (
  SELECT *, row_number() OVER (PARTITION BY env ORDER BY {draw(SEED, 'batch', 'env', 'example_id')}, example_id) - 1 AS rank
  FROM encoded2 WHERE env <> 'val'),
bat2 AS (SELECT *, CAST(rank // {BATCH} AS INTEGER) AS batch_id FROM bat)"""
_CB = _CORPUS_B[len("WITH "):].rstrip()
SQL["tsv_roundtrip"] = with_(_CB) + "SELECT env, labels, md5(text) AS text_md5 FROM lines"
SQL["vocab"] = with_(_CB, _VOCAB) + "SELECT * FROM vocab"
SQL["encoded"] = with_(_CB, _VOCAB, _ENC) + "SELECT env, example_id, labels, input_ids, attention_mask FROM encoded2"
SQL["encoded_repeated_ids"] = with_(_CB, _VOCAB, f"""twice AS (SELECT env, example_id, labels, text FROM lines WHERE env <> 'val'
  UNION ALL SELECT 'again_' || env, example_id, labels, reverse(text) FROM lines WHERE env <> 'val')""",
    _ENC.replace("FROM lines WHERE", "FROM twice WHERE")) + "SELECT env, example_id, labels, input_ids, attention_mask FROM encoded2"
SQL["batches"] = with_(_CB, _VOCAB, _ENC, _BAT) + "SELECT env, example_id, rank, batch_id FROM bat2"
SQL["padded"] = with_(_CB, _VOCAB, _ENC, _BAT) + """SELECT env, batch_id, example_id,
  ids0 || list_transform(range(0, greatest(mx - len(ids0), 0)), lambda x: 0) AS input_ids,
  am0 || list_transform(range(0, greatest(mx - len(ids0), 0)), lambda x: 0) AS attention_mask
FROM (SELECT env, batch_id, example_id, input_ids AS ids0, attention_mask AS am0,
             max(len(input_ids)) OVER (PARTITION BY env, batch_id) AS mx FROM bat2)"""
_PLAN = f"""tr_nb AS (SELECT * FROM lines WHERE env <> 'val' AND text IS NOT NULL AND regexp_matches(text, '{NON_WHITESPACE}')),
plan AS (
  SELECT min(n) AS min_env_size, count(*) AS n_envs, (SELECT count(DISTINCT labels) FROM tr_nb) AS num_labels,
         CAST(floor(min(n) / {ACCUM * BATCH}) AS BIGINT) AS steps_per_epoch, CAST({EPOCHS} AS BIGINT) AS num_epochs,
         CAST(floor(min(n) / {ACCUM * BATCH}) * {EPOCHS} AS BIGINT) AS max_steps
  FROM (SELECT env, count(*) AS n FROM tr_nb GROUP BY env))"""
SQL["epoch_plan"] = with_(_CB, _PLAN) + "SELECT * FROM plan"
SQL["step_schedule"] = with_(_CB, _VOCAB, _ENC, _BAT, _PLAN) + """, envs AS (
  SELECT env, max(batch_id) + 1 AS n_batches, row_number() OVER (ORDER BY env) - 1 AS env_idx, count(*) OVER () AS n_envs
  FROM bat2 GROUP BY env)
SELECT s.range AS step, e.env, CAST((s.range // e.n_envs) % e.n_batches AS INTEGER) AS batch_id
FROM range(0, (SELECT max_steps FROM plan)) s JOIN envs e ON s.range % e.n_envs = e.env_idx"""


# ---------------------------------------------------------------- training-log streams
from envlab.checks.sqlfrag import TRAIN_LOG  # noqa: E402

SQL["loss_moving_avg"] = with_(TRAIN_LOG) + """SELECT run, step, train_loss,
  round(avg(train_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS train_loss_moving_avg
FROM train_log"""
SQL["loss_moving_avg_stream"] = SQL["loss_moving_avg"]
SQL["heads_compact_stream"] = SQL["heads_compact"]


# ---------------------------------------------------------------- 9-digit rounding identical to the Spark side
def _r9_expr(e: str) -> str:
    return (f"(CASE WHEN isnan({e}) OR abs({e}) >= 1e9 THEN ({e}) "
            f"ELSE floor(({e}) * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE END)")


def _fix_round(sql: str) -> str:
    """Rewrite every ``round(<expr>, 9)`` into the half-up floor form of :func:`registry.r9`."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6:k - 1]
        if inner.rstrip().endswith(", 9"):
            out.append(sql[i:j] + _r9_expr(_fix_round(inner.rstrip()[:-3])))
        else:
            out.append(sql[i:k])
        i = k



# ---------------------------------------------------------------- evaluation every n steps
from envlab.plans.registry import EVAL_STEPS  # noqa: E402

_SNAP = with_(HEAD_WEIGHTS, _STEP_LOGITS, f"""snap AS (
  SELECT step, example_id, env, logits, CAST(example_id % len(logits) AS INTEGER) AS label
  FROM step_logits WHERE step % {EVAL_STEPS} = 0)""", _ens("snap", "step"), _report("step"))
_EVAL_BY_STEP = _SNAP + f""", loss AS (
  SELECT step, avg(list_max(logits) + ln(list_reduce(list_transform(logits, lambda x: exp(x - list_max(logits))), lambda a, b: a + b, 0.0::DOUBLE))
                   - logits[label + 1]) AS loss FROM pred GROUP BY step)
SELECT r.step, {_fix_round(', '.join(f'round({c}, 9) AS {c}' for c in ['loss'] + _REPORT_COLS))},
       {_fix_round('round(f1_head - f1_tail, 9)')} AS gap_head_tail
FROM rep r JOIN loss l ON r.step = l.step"""
SQL["eval_by_step"] = _EVAL_BY_STEP
SQL["eval_stream"] = _EVAL_BY_STEP



# ---------------------------------------------------------------- sinks and the corpus reader, written and read back
from envlab.plans.registry import CADENCE  # noqa: E402

SQL["loss_cadence_stream"] = f"SELECT * FROM ({SQL['loss_moving_avg']}) WHERE step % {CADENCE} = 0"
SQL["corpus_read"] = with_(BIOS) + "SELECT example_id, profession, gender, split, md5(text) AS text_md5 FROM bios"
SQL["support_csv"] = SQL["support_report"]
SQL["pooled_tsv"] = with_(_CB) + "SELECT 'erm' AS env, labels, md5(text) AS text_md5 FROM lines WHERE env <> 'val'"
SQL["val_tsv"] = with_(_CB) + "SELECT env, labels, md5(text) AS text_md5 FROM lines WHERE env = 'val'"
SQL["encoded_stored"] = SQL["encoded"]
SQL["head_snapshots"] = SQL["head_weight_divergence"]
SQL["map_batches"] = """SELECT doc_id AS example_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
  CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents"""


# every twin: ``round(x, 9)`` -> the engine-independent half-up form (keep this last)
SQL = {k: _fix_round(v) for k, v in SQL.items()}

SQL["loss_moving_avg_disordered"] = SQL["loss_moving_avg"]
SQL["eval_stream_parts"] = SQL["eval_by_step"]
SQL["log_appends"] = with_(EVENT_STEPS) + """SELECT 'run ' || CAST(user_id AS VARCHAR) AS run, step, round(value, 9) AS train_loss,
  CAST(NULL AS DOUBLE) AS train_loss_moving_avg, step // 50 AS round FROM event_steps"""
SQL["head_js_first_batches"] = SQL["head_js"].replace(
    "bat AS (SELECT pos // 64 AS batch, avg(js) AS js, avg(dis) AS dis FROM pos GROUP BY ALL)",
    f"bat AS (SELECT pos // 64 AS batch, avg(js) AS js, avg(dis) AS dis FROM pos WHERE pos < {64 * EVAL_BATCHES} GROUP BY ALL)",
)
SQL["custom_metric"] = with_(head_logits(), _ens()) + """SELECT class,
  round(CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0.0 END, 9) AS f2 FROM pc"""
SQL["padded_fixed"] = with_(_CB, _VOCAB, _ENC, _BAT) + f"""SELECT env, batch_id, example_id,
  ids || list_transform(range(0, {FIXED_LENGTH} - len(ids)), lambda x: 0) AS input_ids,
  list_transform(ids, lambda x: 1) || list_transform(range(0, {FIXED_LENGTH} - len(ids)), lambda x: 0) AS attention_mask
FROM (SELECT *, CASE WHEN len(input_ids) > {FIXED_LENGTH} THEN input_ids[:{FIXED_LENGTH - 1}] || [3] ELSE input_ids END AS ids FROM bat2)"""

# a corpus without ids: positions in the order of the splits and of the rows in them
_BY_POSITION = BIOS.replace("bios AS", "bios0 AS") + """,
bios AS (SELECT CAST(row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, example_id) - 1 AS BIGINT) AS example_id,
  text, profession, gender, split FROM bios0)"""
for _name in ("corpus_a", "corpus_b", "support_report"):
    SQL[f"{_name}_positions"] = SQL[_name].replace(BIOS, _BY_POSITION)
SQL["corpus_positions"] = with_(_BY_POSITION) + """SELECT example_id, profession, gender, split, md5(text) AS text_md5
FROM bios WHERE example_id % 7 <> 0"""
SQL["encoded_content"] = SQL["encoded"]
SQL["curve_summary_refreshed"] = SQL["curve_summary"]
SQL["seed_csv"] = SQL["seed_aggregate"]
SQL["curve_csv"] = f"WITH c AS ({SQL['curve_summary']}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, lr, step, {m} AS mean, {m}_std AS std FROM c" for m in DEFAULT_METRICS
)
