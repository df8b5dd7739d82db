"""Queries over the training-data operators, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm.byte_bpe import encode_documents
from textpairs.llm.chat import format_conversations
from textpairs.llm.common import table
from textpairs.llm.decontaminate import find_passages
from textpairs.llm.jaccard_join import jaccard_classes
from textpairs.llm.licenses import scan_licenses
from textpairs.llm.line_dedup import drop_repeated_lines
from textpairs.llm.quality import ALPHA, DELTA, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, screen_documents, settings
from textpairs.llm.repeats import remove_repeats
from textpairs.llm.sentence_pieces import encode_pieces
from textpairs.llm.sharding import curve_automaton, hilbert_shards
from textpairs.llm.structure import damage, repair_conversations
from textpairs.llm.token_counts import count_tokens
from textpairs.llm.vector_codes import Codebooks, compress_vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _hilbert_sql() -> str:
    following, digits = curve_automaton(3)
    step = """SELECT * EXCLUDE (state, place, cell), {f}[state * 8 + cell + 1] AS state,
        place * 8 + {d}[state * 8 + cell + 1] AS place
        FROM (SELECT *, (((l0 >> {b}) & 1) + 2 * ((l1 >> {b}) & 1) + 4 * ((l2 >> {b}) & 1)) AS cell FROM ({inner}))"""
    inner = "SELECT *, 0 AS state, 0::BIGINT AS place FROM levels"
    for b in (5, 4, 3, 2, 1, 0):
        inner = step.format(f=following, d=digits, b=b, inner=inner)
    return inner


_LEVELS = """SELECT v, n, floor(coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    * 64 / (SELECT count(*) FROM documents))::INT AS level FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY 1)"""

OP1_SQL = f"""WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
hexed AS (SELECT doc_id, lang, source, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
checked AS (SELECT doc_id, lang, source, strlen(body)::BIGINT + 1 AS size,
  xor(list_reduce(range(strlen(body)::BIGINT),
    lambda c, k: xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255) + 1]), 4294967295::BIGINT),
    4294967295) AS crc FROM hexed, crc_table),
langs AS ({_LEVELS.format(c='lang')}), sources AS ({_LEVELS.format(c='source')}),
levels AS (SELECT c.*, a.level AS l0, b.level AS l1,
  least(2 * (length(bin(size)) - 1) + (substr(bin(size), 2, 1) = '1')::INT, 63) AS l2 FROM checked c
  JOIN langs a ON a.v IS NOT DISTINCT FROM c.lang JOIN sources b ON b.v IS NOT DISTINCT FROM c.source),
ranked AS (SELECT *, row_number() OVER (ORDER BY place, doc_id NULLS FIRST, crc, size) - 1 AS rank,
  count(*) OVER () AS total FROM ({_hilbert_sql()}))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (rank * 8 // total)::INT AS shard,
  rank - ((rank * 8 // total) * total + 7) // 8 AS slot, NULL::INT AS grown_shard FROM ranked"""


@query(OP1_SQL)
def op1_hilbert_shards(spark, sf_dir):
    placed = hilbert_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP2_SQL = r"""WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
marked AS (SELECT *, length(k) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


@query(OP2_SQL)
def op2_line_dedup(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


@query()
def op10_byte_bpe(spark, sf_dir):
    rows = encode_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_RULE_ROWS = ", ".join(f"('{rule}', {cut}, {step})" for step, (rule, cut) in enumerate(settings()))
_FIRES = "CASE rule " + " ".join(
    f"WHEN '{rule}' THEN 1000 * {a} {'>' if side == 'above' else '<'} cut * {b}" for rule, (a, b, side, _) in RULES.items()
) + " END"
OP3_SQL = rf"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
  generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS pos FROM texts),
tri AS (SELECT doc_id, pos, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM ws WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS r FROM tri),
cov AS (SELECT doc_id, r OR coalesce(lag(r) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS c FROM rep
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM cov GROUP BY 1),
ls AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ls
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, stratum, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines FROM texts LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
cuts(rule, cut, step) AS (VALUES {_RULE_ROWS}),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY 1),
held AS (SELECT b.*, quality FROM b JOIN known USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT stratum, count(*) FILTER (quality = 1) AS n_good FROM held GROUP BY 1),
useful AS (SELECT DISTINCT stratum, rule, cut, step FROM held, cuts WHERE quality = 0 AND {_FIRES}),
firsts AS (SELECT doc_id, stratum, any_value(quality) AS quality, min(step) AS step FROM held JOIN useful USING (stratum) WHERE {_FIRES} GROUP BY ALL),
steps AS (SELECT u.stratum, u.step, count(doc_id) FILTER (quality = 1) AS k, count(doc_id) FILTER (quality = 0) AS bad
  FROM useful u LEFT JOIN firsts f ON f.stratum = u.stratum AND f.step <= u.step GROUP BY ALL),
p AS (SELECT stratum, step, k, bad, CASE WHEN k >= n THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END)
  - (CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
  FROM (SELECT unnest(range(k + 1)) AS i)) END AS tail FROM (SELECT *, n_good AS n FROM steps JOIN strata USING (stratum))),
failed AS (SELECT stratum, min(step) FILTER (tail > {DELTA} / (SELECT count(*) FROM strata)) AS stop FROM p GROUP BY 1),
best AS (SELECT stratum, first(step ORDER BY bad - k DESC, step) AS taken FROM p JOIN failed USING (stratum)
  WHERE (stop IS NULL OR step < stop) AND bad > k GROUP BY 1),
fired AS (SELECT DISTINCT doc_id FROM b JOIN best USING (stratum) JOIN useful USING (stratum) WHERE step <= taken AND {_FIRES})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM fired) AS kept FROM b"""


@query(OP3_SQL)
def op3_risk_controlled(spark, sf_dir):
    rows = screen_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM ws WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x WHERE r.root < l.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x, min(root) AS root FROM reach GROUP BY 1) ON x = d.doc_id"""


@query(OP6_SQL)
def op6_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query()
def op4_deep_shallow(spark, sf_dir):
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = r"""WITH dl AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
il AS (SELECT item_id, w, len(w) AS m, least(len(w), 4) AS n FROM (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0),
dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM dl),
iw AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos, m FROM il),
dg AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'pos': i, 'g': array_to_string(w[i:i + n - 1], ' ')})) AS x
  FROM dl, (SELECT DISTINCT n FROM il)),
ig AS (SELECT item_id, n, unnest(list_transform(range(1, m - n + 2), lambda i: {'pos': i, 'g': array_to_string(w[i:i + n - 1], ' ')})) AS x FROM il),
laid AS (SELECT DISTINCT doc_id, item_id, d.x.pos - i.x.pos AS shift FROM dg d JOIN ig i ON d.n = i.n AND d.x.g = i.x.g),
eq AS (SELECT l.doc_id, l.item_id, shift, i.pos, m, (d.w = i.w)::INT AS e FROM laid l JOIN iw i ON i.item_id = l.item_id
  JOIN dw d ON d.doc_id = l.doc_id AND d.pos = i.pos + shift),
wins AS (SELECT *, sum(e) OVER o AS s, count(*) OVER o AS n, sum(e) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM eq
  WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT doc_id, item_id, max(s)::BIGINT AS best_window, max(total)::BIGINT AS matched FROM (
  SELECT doc_id, item_id, shift, max(s) AS s, max(total) AS total FROM wins
  WHERE n = least(13, m) AND s >= CASE WHEN m >= 13 THEN 11 WHEN m >= 9 THEN m - 1 ELSE m END GROUP BY ALL) GROUP BY ALL"""


@query(OP9_SQL)
def op9_spaced_seeds(spark, sf_dir):
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_linear_pieces(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


OP7_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(role || chr(1) || text, chr(2)) OVER o AS head FROM t
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT md5(head) AS head, k, max(n) AS longest, min(conv_id) FILTER (n = k) AS first FROM p GROUP BY ALL),
kept AS (SELECT p.conv_id FROM p JOIN h ON md5(p.head) = h.head AND p.k = h.k WHERE p.k = p.n AND longest = p.n AND first = p.conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) ||
  replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id"""


@query(OP7_SQL)
def op7_snapshot_collapse(spark, sf_dir):
    return format_conversations(table(spark, sf_dir, "conversations"))


@query()
def op8_conditional_compression(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """One step of the cheapest edits per state (nothing yet, system, user, assistant): nine digits of cost, then the edits."""

    def after(state: str, cost: str, edit: str) -> str:
        return f"(CASE WHEN {state} = '~' THEN '~' ELSE lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}' END)"

    def stays(state: str, to: str) -> str:
        keep = after(state, "(x[2] = 'truncated')::INT * 3", "K")
        rerole = after(state, "3 + (x[2] = 'truncated')::INT * 3", "R")
        return f"(CASE WHEN x[2] IN ('blank', 'duplicate') THEN '~' WHEN x[1] = '{to}' THEN {keep} ELSE {rerole} END)"

    system = f"(CASE WHEN x[1] = 's' AND x[2] NOT IN ('blank', 'duplicate') THEN {after('c[1]', "(x[2] = 'truncated')::INT * 3", 'K')} ELSE '~' END)"
    empty, user, assistant = (after(f"c[{i}]", "4", "D") for i in (1, 3, 4))
    rows = f"""[{empty}, least({after('c[2]', '4', 'D')}, {system}),
      least({user}, {stays('c[1]', 'u')}, {stays('c[2]', 'u')}, {stays('c[4]', 'u')}), least({assistant}, {stays('c[3]', 'a')})]"""
    inserted = f"[v[1], v[2], least(v[3], {after('v[1]', '3', 'I')}, {after('v[2]', '3', 'I')}, {after('v[4]', '3', 'I')}), v[4]]"
    closed = f"[w[1], w[2], w[3], least(w[4], {after('w[3]', '3', 'I')})]"
    return f"list_transform(list_transform([{rows}], lambda v: {inserted}), lambda w: {closed})[1]"


OP11_SQL = rf"""WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS h FROM conversations),
harmed AS (SELECT *, xor(list_reduce(range(strlen(h)::BIGINT), lambda c, k: xor(c >> 8, t[(xor(c, unicode(substr(h, k + 1, 1))) & 255) + 1]),
  4294967295::BIGINT), 4294967295) % 20 AS harm FROM src, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM harmed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
kinds AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'sound' END AS kind FROM numbered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
  count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal, list([ini, kind] ORDER BY i) AS steps,
  list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM kinds GROUP BY conv_id),
solved AS (SELECT *, list_reduce(steps, lambda c, x: {_repair_sql()}, ['000000000', '~', '000000003I', '000000006II']) AS c FROM counted),
best AS (SELECT * EXCLUDE (c), left(least(c[1], c[4]), 9)::BIGINT AS cost, substr(least(c[1], c[4]), 10) AS audit FROM solved),
edits AS (SELECT conv_id, roles, texts, unnest(range(1, length(audit) + 1)) AS k, audit, audit[k] AS e,
  length(replace(audit[1:k], 'I', '')) AS place, length(replace(audit[1:k], 'D', '')) AS nth FROM best),
opened AS (SELECT conv_id, max((nth = 1 AND e = 'K' AND left(roles[place], 1) = 's')::INT) AS system FROM edits WHERE e <> 'D' GROUP BY 1),
lines AS (SELECT e.conv_id, k, CASE WHEN e = 'K' THEN roles[place] WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN e = 'I' THEN '' ELSE texts[place] END AS line FROM edits e JOIN opened o ON o.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS body FROM lines GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query(OP11_SQL)
def op11_auction_repair(spark, sf_dir):
    rows = repair_conversations(damage(table(spark, sf_dir, "conversations")), present=F.col("present"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return rows.select(*[c for c in rows.columns if c != "turns"], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


@query()
def op12_sentence_pieces(spark, sf_dir):
    rows = encode_pieces(table(spark, sf_dir, "documents"), packed=True)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _codes_sql() -> str:
    """The books of each round, from those of the round before."""
    nearest = """SELECT rid, label, v.p, v.v, min(list_sum(list_transform(range(1, len(v.v) + 1),
      lambda i: (v.v[i] - b.v[i]) * (v.v[i] - b.v[i])))::BIGINT * 64 + b.e) AS m FROM parts v JOIN {books} b ON b.p = v.p GROUP BY ALL"""
    means = """SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM {books} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
      FROM (SELECT p, m % 64 AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM {near}, range(1, (SELECT max(len(v)) FROM parts) + 1) r(i) GROUP BY ALL)
      GROUP BY ALL) n ON n.p = b.p AND n.e = b.e"""
    out = []
    for k in range(2):
        out.append(f"near{k} AS ({nearest.format(books=f'books{k}')}), books{k + 1} AS ({means.format(books=f'books{k}', near=f'near{k}')})")
    return ",\n".join([*out, f"near2 AS ({nearest.format(books='books2')})"])


OP13_SQL = rf"""WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS rid,
  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, label, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS v FROM kept, range(16) r(p)),
books0 AS (SELECT p, rid AS e, v FROM parts WHERE rid < 64),
{_codes_sql()},
coded AS (SELECT rid, label, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY ALL),
hashed AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY c.label)::BIGINT AS label_error, codebooks_sha256
FROM coded c JOIN kept USING (rid), hashed"""


@query(OP13_SQL)
def op13_memoised_cells(spark, sf_dir):
    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    digest = Codebooks(books).digest() if books is not None else None
    return rows.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
