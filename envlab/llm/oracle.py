"""DuckDB twins of the registered queries that SQL can express on whole tables. The others (trained
models, graphs, archives, perfect hashing, XXH64, patience diff) are tested against brute force."""
from __future__ import annotations

import re

from envlab.checks.sqlfrag import draw
from envlab.llm import chat, decontam, fim, mixing, mtree
from envlab.llm.queries import MIX

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chat() -> str:
    t = chat.INSTRUCT
    # characters that escaping adds: one wherever a head, backslashes and the rest stand
    esc = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in t.controls)
    marks = " ".join(f"WHEN '{r}' THEN {len(m.open + m.close)}" for r, m in t.roles.items())
    other = len(t.other.open + t.other.close + t.name.open + t.name.close)
    known = ", ".join(f"'{r}'" for r in t.roles)
    loss = ", ".join(f"'{r}'" for r, m in t.roles.items() if m.loss)
    letter = {r: chr(ord("a") + i) for i, r in enumerate(t.roles)}
    code = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in letter.items())
    # the machine's state is the last role, so allowed neighbours decide
    follow = " ".join(f"WHEN '{a}{b}' THEN true" for a, b in (
        ("^" if x == t.start else letter[x], letter[r]) for (x, r) in t.moves
    ))
    final = ", ".join(f"'{letter[x]}'" for x in t.final)
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE role {code} ELSE '?' END AS c,
    CASE role {marks} ELSE {other} END
      + CASE WHEN role IN ({known}) THEN 0 ELSE length(role) + len(regexp_extract_all(role, '{esc}')) END
      + length(text) + len(regexp_extract_all(text, '{esc}')) AS chars
  FROM rows_),
ordered AS (
  SELECT *, lag(c, 1, '^') OVER w AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE p || c {follow} ELSE false END) AND max(CASE WHEN i = n THEN c END) IN ({final}) AS valid
FROM ordered GROUP BY conv_id"""


def _mixing() -> str:
    t = MIX
    langs, topics = [*t.language, "~"], [*t.topic, "~"]
    nl, nt = len(langs), len(topics)

    def place(col: str, named) -> str:
        return f"coalesce(list_position({list(named)!r}, {col}), {len(named) + 1}) - 1"

    def wanted(named) -> str:
        whole = sum(named.values()) + t.rest
        return "[" + ", ".join(f"{v / whole!r}::DOUBLE" for v in [*named.values(), t.rest]) + "]"

    topic = " ".join(f"WHEN contains(coalesce(text, ''), '{m}') THEN '{n}'" for n, m in mixing.TOPICS)
    wl, wt = wanted(t.language), wanted(t.topic)

    def held(size: int, by_lang: bool, m: str, fl: str | None, ft: str | None) -> str:
        """Mass by language (or topic), as a list."""
        other = nt if by_lang else nl
        at = f"i * {nt} + j + 1" if by_lang else f"j * {nt} + i + 1"
        a, b = ("i", "j") if by_lang else ("j", "i")
        factor = (f" * {fl}[{a} + 1]" if fl else "") + (f" * {ft}[{b} + 1]" if ft else "")
        return f"list_transform(range(0, {size}), lambda i: list_sum(list_transform(range(0, {other}), lambda j: {m}[{at}]{factor})))"

    def have(h: str, want: str) -> str:
        return f"list_sum(list_transform({h}, lambda x, i: CASE WHEN x > 0 THEN {want}[i] ELSE 0.0 END))"

    def fitted(h: str, want: str) -> str:
        return f"list_transform({h}, lambda x, i: CASE WHEN x > 0 THEN {want}[i] / {have(h, want)} / x ELSE 0.0 END)"

    def off(h: str, want: str) -> str:
        return f"list_max(list_transform({h}, lambda x, i: CASE WHEN x > 0 THEN abs(x - {want}[i] / {have(h, want)}) ELSE 0.0 END))"

    def masses(state: str, carry: str) -> str:
        """Per state row: the mass of every (language, topic), source factors fitted first."""
        return f"""SELECT {carry}, list_transform(range(0, {nl * nt}), lambda k: coalesce(map_extract(mk, k)[1], 0.0)) AS m FROM (
      SELECT {carry}, map(list(k), list(x)) AS mk FROM (
        SELECT {carry}, k, sum(n * sf) AS x FROM (
          SELECT {carry}, k, n, want / sum(n * fl[l + 1] * ft[t + 1]) OVER (PARTITION BY source) AS sf
          FROM {state} CROSS JOIN (SELECT *, l * {nt} + t AS k FROM cells JOIN src USING (source)))
        GROUP BY ALL) GROUP BY ALL)"""

    gap = f"greatest({off('hl', wl)}, {off('ht', wt)})"
    measured = lambda rows: f"""SELECT i, fl, ft, m, {gap} AS gap FROM (
      SELECT *, {held(nl, True, 'm', 'fl', 'ft')} AS hl, {held(nt, False, 'm', 'fl', 'ft')} AS ht FROM ({rows}))"""  # noqa: E731
    ones = lambda n: "[" + ", ".join(["1.0::DOUBLE"] * n) + "]"
    start = f"(SELECT 0 AS i, {ones(nl)} AS fl, {ones(nt)} AS ft)"
    step = f"""(SELECT i, fl, {fitted('h2', wt)} AS ft FROM (SELECT *, {held(nt, False, 'm', 'fl', None)} AS h2 FROM (
      SELECT i + 1 AS i, {fitted('h1', wl)} AS fl, m FROM (SELECT *, {held(nl, True, 'm', None, 'ft')} AS h1 FROM it
        WHERE i < {mixing.SWEEPS} OR (i < {mixing.MAX_SWEEPS} AND gap > {mixing.TOLERANCE!r}::DOUBLE)))))"""
    name = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE {topic} ELSE '{mixing.OTHER_TOPIC}' END AS topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS BIGINT) AS tokens FROM documents),
cells AS MATERIALIZED (SELECT source, {place('lang', t.language)} AS l, {place('topic', t.topic)} AS t, sum(tokens)::DOUBLE AS n
  FROM d GROUP BY ALL HAVING sum(tokens) > 0),
src AS MATERIALIZED (SELECT source, want / sum(want) OVER () AS want FROM (
  SELECT source, pow(sum(n) / (SELECT sum(n) FROM cells), {t.source_power}::DOUBLE) AS want FROM cells GROUP BY source)),
it AS (
  {measured(masses(start, 'i, fl, ft'))}
  UNION ALL
  {measured(masses(step, 'i, fl, ft'))}),
last AS MATERIALIZED (SELECT fl, ft FROM it ORDER BY i DESC LIMIT 1),
wts AS MATERIALIZED (SELECT source, l, t, want / sum(n * fl[l + 1] * ft[t + 1]) OVER (PARTITION BY source) * fl[l + 1] * ft[t + 1]
    * (SELECT sum(n) FROM cells) AS weight FROM cells JOIN src USING (source) CROSS JOIN last),
occupied AS (SELECT source, lang, topic FROM d GROUP BY ALL HAVING sum(tokens) > 0),
joined AS (SELECT d.*, CASE WHEN o.source IS NULL THEN 0.0 ELSE w.weight END AS weight
  FROM d LEFT JOIN occupied o USING (source, lang, topic)
  LEFT JOIN wts w ON w.source = d.source AND w.l = {place('d.lang', t.language)} AND w.t = {place('d.topic', t.topic)}),
expected AS (SELECT *, weight * {mixing.BUDGET}::DOUBLE AS e FROM joined),
copied AS (SELECT *, CAST(floor(e) AS BIGINT) + CASE WHEN {draw(mixing.SEED, 'mix', name)} < e - floor(e) THEN 1 ELSE 0 END AS copies FROM expected)
SELECT doc_id, topic, tokens, round(weight, 9) AS weight, round(least(e, 1.0), 9) AS chance, copies, copies > 0 AS kept
FROM copied"""


def _decontamination() -> str:
    k = decontam.WINDOW
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
        r"'[0-9a-z\x{80}-\x{10FFFF}]+')"
    )
    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item, len(x) AS n, x[1] AS head, array_to_string(x, ' ') AS x FROM (
    SELECT item, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: w[i:i + {k - 1}])) AS x
    FROM item WHERE len(w) > 0)),
doc AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
heads AS MATERIALIZED (SELECT DISTINCT head FROM win),
place AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM doc),
hit AS MATERIALIZED (
  SELECT p.doc_id, p.i, s.n, win.item FROM place p SEMI JOIN heads ON word = head JOIN doc USING (doc_id) CROSS JOIN sizes s
  JOIN win ON win.n = s.n AND win.x = array_to_string(w[p.i:p.i + s.n - 1], ' ') WHERE p.i + s.n - 1 <= len(w)),
words_hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)"""


def _topk(every: int = 50, k: int = 5) -> str:
    # sums of products of integers below 2**53 are exact in double precision, in any order
    return f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({mtree.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS v FROM v WHERE vec_id % {every} = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, max(CAST(list_inner_product(q.v, v.v) AS BIGINT)) AS score
  FROM q JOIN v ON query_id <> vec_id AND len(q.v) = len(v.v) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def _fim() -> str:
    h = ", ".join(f"CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS s FROM documents),
e AS (SELECT doc_id, text, length(text) AS n, {h} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {fim.PLAIN_FROM} THEN '{fim.PLAIN}'
    WHEN h4 % 100 < {fim.SPM_BELOW} THEN '{fim.SPM}' ELSE '{fim.PSM}' END AS form FROM e),
g AS (SELECT *, substr(text, 1, i) AS a, substr(text, i + 1, j - i) AS b, substr(text, j + 1) AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> '{fim.PLAIN}' THEN i END AS prefix_chars, CASE WHEN form <> '{fim.PLAIN}' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN '{fim.PLAIN}' THEN text WHEN '{fim.PSM}' THEN '{p}' || a || '{s}' || c || '{m}' || b
    ELSE '{s}' || c || '{p}' || a || '{m}' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM g"""


SQL: dict[str, str] = {
    "op1_chat": _chat(), "op2_mixing": _mixing(), "op3_decontamination": _decontamination(), "op12_topk": _topk(), "op13_fim": _fim(),
}
