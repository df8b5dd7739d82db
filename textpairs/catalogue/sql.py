"""SQL building blocks of the counterparts, written against the same sample tables."""

from __future__ import annotations

from textpairs.functions.text import KNOWN_TYPOS

PAIRS = """
lines AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS parts,
         CASE WHEN l.toxic = 1 THEN 'contradiction' WHEN l.quality = 1 THEN 'entailment'
              WHEN l.quality = 0 THEN 'neutral' END AS label
  FROM documents d LEFT JOIN labels l USING (doc_id)),
numbered AS (SELECT *, unnest(range(0, greatest(len(parts) - 1, 1))) AS pos FROM lines),
pairs AS (
  SELECT doc_id * 1000000 + pos AS idx, doc_id, pos, nullif(parts[pos + 1], '') AS premise,
         nullif(parts[pos + 2], '') AS hypothesis, label
  FROM numbered)"""

COMPLETE = (
    PAIRS
    + """,
complete AS (
  SELECT idx, premise, hypothesis,
         CASE label WHEN 'contradiction' THEN 0 WHEN 'entailment' THEN 1 ELSE 2 END AS label
  FROM pairs WHERE premise IS NOT NULL AND hypothesis IS NOT NULL AND label IS NOT NULL)"""
)

DIRTY = (
    PAIRS
    + f""",
dirty AS (
  SELECT idx, hypothesis, label, CASE (doc_id + pos) % 8
    WHEN 0 THEN substr(premise, 1, 1) || chr(160) || substr(premise, 2)
    WHEN 1 THEN substr(premise, 1, 1) || chr(8) || substr(premise, 2)
    WHEN 2 THEN '《' || premise || '》'
    WHEN 3 THEN '『' || premise || '』'
    WHEN 4 THEN substr(premise, 1, 1) || '…' || substr(premise, 2)
    WHEN 5 THEN premise || '．'
    WHEN 6 THEN replace(premise, ' ', chr(9) || chr(10) || chr(12288) || chr(8195) || chr(28))
    ELSE premise || CASE WHEN idx % 2 = 0 THEN '{KNOWN_TYPOS[0][0]}' ELSE '{KNOWN_TYPOS[1][0]}' END || premise
    END AS premise
  FROM pairs)"""
)

DIALOG = """
dialog AS (
  SELECT conv_id * 1000 + turn AS idx, text AS premise, reply AS hypothesis FROM (
    SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND reply_role = 'assistant')"""

SCORES = """
scores AS (
  SELECT m::int AS model_id, vec_id AS row_id, label % 3 AS gold, embedding[m + 1]::double AS a,
         embedding[(m + 1) % n + 1]::double AS b, embedding[(m + 2) % n + 1]::double AS c
  FROM (SELECT *, len(embedding) AS n, unnest(range(len(embedding))) AS m FROM embeddings)),
probs AS (
  SELECT *, exp(a - t) / (exp(a - t) + exp(b - t) + exp(c - t)) AS p0,
         exp(b - t) / (exp(a - t) + exp(b - t) + exp(c - t)) AS p1,
         exp(c - t) / (exp(a - t) + exp(b - t) + exp(c - t)) AS p2
  FROM (SELECT *, greatest(a, b, c) AS t FROM scores))"""

BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def typo(x: str) -> str:
    (bad1, good1), (bad2, good2) = KNOWN_TYPOS
    first = f"CASE WHEN contains({x}, '{bad1}') THEN '{good1}' ELSE {x} END"
    return f"CASE WHEN contains({first}, '{bad2}') THEN '{good2}' ELSE {first} END"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}', ' ', 'g'), ' ')"


def clean(x: str) -> str:
    out = f"replace(replace({typo(x)}, chr(160), ''), chr(8), '')"
    for c in "《》『』…":
        out = f"replace({out}, '{c}', ' ')"
    return squeezed(f"replace({out}, '．', '.')")


def draw(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint"


def label_id(x: str) -> str:
    return f"CASE {x} WHEN 'contradiction' THEN 0 WHEN 'entailment' THEN 1 WHEN 'neutral' THEN 2 END"


def label_name(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'contradiction' WHEN 1 THEN 'entailment' WHEN 2 THEN 'neutral' END"


def folds(source: str, key: str = "idx", label: str = "label", k: int = 5, seed: int = 42) -> str:
    """CTE ``folded``: rows of ``source`` with their fold."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {draw(seed, key)}, {key}) - 1 AS r FROM {source}),
label_n AS (
  SELECT {label} AS l, count(*) AS n, sum(count(*)) OVER (ORDER BY {label}) - count(*) AS start FROM {source} GROUP BY 1),
fold_n AS (
  SELECT l, f, n // {k} + CASE WHEN (f - start % {k} + {k}) % {k} < n % {k} THEN 1 ELSE 0 END AS c
  FROM label_n, range({k}) t(f)),
fold_range AS (
  SELECT l, f, sum(c) OVER (PARTITION BY l ORDER BY f) AS hi,
         sum(c) OVER (PARTITION BY l ORDER BY f) - c AS lo FROM fold_n),
folded AS (
  SELECT ranked.*, f::int AS fold FROM ranked JOIN fold_range ON {label} = l AND r >= lo AND r < hi)"""


def vocabulary(source: str) -> str:
    """CTE ``vocab`` over the cleaned premise and hypothesis of ``source``."""
    return f"""
all_words AS (
  SELECT unnest(string_split({clean('premise')}, ' ')) AS token FROM {source}
  UNION ALL SELECT unnest(string_split({clean('hypothesis')}, ' ')) FROM {source}),
vocab AS (
  SELECT token, n AS token_count, row_number() OVER (ORDER BY n DESC, token) + 4 AS token_id
  FROM (SELECT token, count(*) AS n FROM all_words WHERE token <> '' GROUP BY 1))"""


def encoded(source: str) -> str:
    """CTE ``encoded``: ``idx, p, h`` id lists of the cleaned texts of ``source`` under CTE ``vocab``."""

    def side(col: str, name: str) -> str:
        return f"""
{name}_words AS (
  SELECT idx, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
  FROM (SELECT idx, string_split({clean(col)}, ' ') AS ws FROM {source})),
{name}_ids AS (
  SELECT idx, list(coalesce(token_id, 3) ORDER BY pos) AS ids
  FROM {name}_words LEFT JOIN vocab USING (token) WHERE token <> '' GROUP BY 1)"""

    return f"""{side('premise', 'p')},{side('hypothesis', 'h')},
encoded AS (
  SELECT s.*, coalesce(p_ids.ids, []::bigint[]) AS p, coalesce(h_ids.ids, []::bigint[]) AS h
  FROM {source} s LEFT JOIN p_ids USING (idx) LEFT JOIN h_ids USING (idx))"""


def assembled(max_length: int | None = None) -> str:
    """CTE ``sequences``: ``encoded`` with its ``input_ids``."""
    body = "list_concat(list_concat(p, [2::bigint]), h)"
    if max_length is not None:
        body = f"list_slice({body}, 1, {max_length - 2})"
    return f"""
sequences AS (
  SELECT *, list_concat(list_concat([0::bigint], {body}), [2::bigint]) AS input_ids FROM encoded)"""
