"""Every operator against a plain version on small documents, and the queries against SQL or a plain version."""

import random
import re
from math import comb
from pathlib import Path

import cases
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import plan, runs_python
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
import corpus_pipeline
from textpairs.llm import catalogue
from textpairs.llm.byte_bpe import RANKS, BytePairs, encode_documents, read_ranks
from textpairs.llm.decontaminate import LENGTHS, MASKS, SHORT_MASKS, find_passages
from textpairs.llm.deep_shallow import deep_shallow_sort, neighbour_prefixes
from textpairs.llm.jaccard_join import jaccard_classes, least_overlap, max_missing
from textpairs.llm.licenses import TEMPLATES, Scanner, scan_licenses
from textpairs.llm.line_dedup import drop_repeated_lines
from textpairs.llm.quality import measure_text, tail
from textpairs.llm.repeats import remove_repeats
from textpairs.llm.sharding import curve_automaton, hilbert_shards
from textpairs.llm.token_counts import PieceCounter

NATIVE = ["op1_hilbert_shards", "op2_line_dedup", "op9_spaced_seeds"]


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    result = sql.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in result.fetchall())))
    assert found


def table_texts(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


def test_every_query_is_registered():
    names = {*catalogue.QUERIES, "pipeline"}
    assert names <= set(driver.queries()) and set(catalogue.ORACLES) <= set(driver.oracle_sql())
    assert [n for n in sorted(names, key=lambda n: int(re.sub(r"\D", "", n.split("_")[0]) or 0)) if n != "pipeline"]
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in catalogue.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf_dir, name):
    assert not runs_python(catalogue.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 3), (4, 2)])
def test_curve_goes_from_cell_to_neighbour(n, bits):
    following, digits = curve_automaton(n)
    cells = {}
    for number in range(1 << (n * bits)):
        point = [(number >> (j * bits)) & ((1 << bits) - 1) for j in range(n)]
        state = place = 0
        for b in range(bits - 1, -1, -1):
            at = state * (1 << n) + sum(((x >> b) & 1) << j for j, x in enumerate(point))
            state, place = following[at], place * (1 << n) + digits[at]
        cells[place] = point
    path = [cells[i] for i in range(1 << (n * bits))]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_runs_of_the_curve(spark, law):
    found = hilbert_shards(cases.documents(spark), 4, law=law).collect()
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in found)
    if law == "rows":
        sizes = [sum(r.shard == s for r in found) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (3, 2), (7, 3)])
def test_lines(spark, batches, fan_in):
    found = drop_repeated_lines(cases.documents(spark), batches=batches, fan_in=fan_in).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in found} == cases.line_dedup(cases.texts())


def test_measures():
    for text in cases.texts().values():
        assert measure_text(text) == cases.measures(text)


@given(st.text(alphabet="ab \n\t#\x1c\xa0É", max_size=60))
@settings(max_examples=200, deadline=None)
def test_measures_of_any_text(text):
    assert measure_text(text) == cases.measures(text)


def test_exact_binomial_tail():
    for n, k, p in ((10, 0, 0.3), (40, 7, 0.01), (200, 30, 0.1), (5, 5, 0.2)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_reject_junk_and_spare_good_documents(spark):
    from textpairs.llm.quality import screen_documents

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(8000):
        bad = i % 4 == 0
        words = [f"word{rng.randrange(9999)}" + ("###" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 0))
        if i % 8 < 6:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    found = screen_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    kept = {r.doc_id for r in found if r.kept}
    # Odd ids are all good: without bad documents nothing is rejected. Even ones are half junk.
    assert kept == {i for i in range(8000) if i % 4}


@pytest.mark.parametrize("large", [10_000, 2])
def test_repeats(spark, large):
    found = remove_repeats(cases.documents(spark), large=large).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in found}
    assert got == cases.repeats(cases.texts())


@given(st.lists(st.binary(max_size=60) | st.text("ab", max_size=90).map(str.encode), max_size=40))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_sort(strings):
    strings = strings + [s + b"\0" for s in strings[:5]]
    order = deep_shallow_sort(strings)
    assert [strings[i] for i in order] == sorted(strings)
    common = neighbour_prefixes(strings, order)
    for at in range(1, len(order)):
        a, b = strings[order[at - 1]], strings[order[at]]
        assert common[at] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_op4_query(spark, sf_dir, sql):
    want = {i: (n, gone, spans, cases.sha(kept)) for i, (n, gone, spans, kept) in cases.repeats(table_texts(sql)).items()}
    assert {r[0]: tuple(r)[1:] for r in catalogue.QUERIES["op4_deep_shallow"](spark, sf_dir).collect()} == want


@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9), st.data())
@settings(max_examples=200, deadline=None)
def test_piece_counts(pieces, data):
    rest = {bytes(reversed(p)) for p in pieces}
    counter = PieceCounter(pieces, rest)
    word = bytes(data.draw(st.lists(st.integers(0, 2), max_size=12)))
    at, want = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else pieces)), None)
        at, want = (len(word), None) if end is None else (end, want + 1)
        if want is None:
            break
    assert counter.pieces(word) == (want or 0)


def test_op5_query(spark, sf_dir, sql):
    from textpairs.llm.token_counts import split_vocabulary

    starts, rest = split_vocabulary(read_ranks(public_tokenizers.path(RANKS)))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + 130), at, -1) if word[at:e] in (rest if at else starts))
            n += 1
        return n

    known = {}
    want = {}
    for i, text in table_texts(sql).items():
        words = (text or "").encode().split()
        want[i] = (len(words), sum(known.setdefault(w, greedy(w)) if w not in known else known[w] for w in words), 0)
    assert {r[0]: tuple(r)[1:] for r in catalogue.QUERIES["op5_linear_pieces"](spark, sf_dir).collect()} == want


def test_classes(spark):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.documents(spark)).collect()}
    assert found == cases.classes(cases.texts())


def test_classes_of_chains_and_stars(spark):
    """Near copies of one text, most of which link only through others."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = {}
    for group in range(4):
        text = [f"g{group}{w}" for w in base]
        for copy in range(30):
            words = list(text)
            for _ in range(copy % 5):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows[len(rows)] = " ".join(words)
        chain = list(text)
        for step in range(12):
            chain[10 * step % 120] = f"c{group}{step}"
            rows[len(rows)] = " ".join(chain)
    order = list(rows)
    rng.shuffle(order)
    docs = {new: rows[old] for new, old in enumerate(order)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.documents(spark, rows=list(docs.items()))).collect()}
    assert found == cases.classes(docs)


def test_bounds_of_the_join():
    for n in range(1, 80):
        for m in range(1, 80):
            linked = [i for i in range(min(n, m) + 1) if 100 * i >= 80 * (n + m - i)]
            assert not linked or linked[0] == least_overlap(n, m)
            assert not linked or n - linked[0] <= max_missing(n)


def test_passages(spark):
    rng = random.Random(3)
    items = {j: cases.sentence(rng, n, 400) for j, n in enumerate((8, 9, 12, 13, 20, 40))}
    docs = dict(cases.texts())
    for i in range(100, 160):
        words = items[i % 6].split()
        for _ in range(i // 6 % 5):
            words[rng.randrange(len(words))] = "other"
        cut = words[: rng.randrange(8, 41)]
        docs[i] = cases.sentence(rng, 30, 400) + " " + " ".join(cut).upper() + "\n" + cases.sentence(rng, 5, 400)
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = cases.passages({i: t for i, t in docs.items() if len(t or "") < 9000}, items)
    rows = [(i, t) for i, t in docs.items() if len(t or "") < 9000]
    for limit in (2_000_000, 0):
        found = find_passages(cases.documents(spark, rows=rows), table, broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item_id): (r.best_window, r.matched) for r in found} == want
    assert len(want) > 20


def test_masks_meet_one_replaced_word_of_short_items():
    for m in range(9, 13):
        for a in range(m):
            assert any(a not in {o + i for i in mask} for mask in SHORT_MASKS for o in range(m - mask[-1]))
    assert all(any(low <= m <= high for low, high, _ in LENGTHS) for m in range(1, 40))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_items_of_every_length(spark, sf_dir, tmp_path, limit):
    """Planted whole, with one word replaced, with two, and cut; the same by SQL."""
    rng = random.Random(12)
    items = {m: cases.sentence(rng, m, 100_000) for m in range(1, 16)}
    items |= {20: None, 21: " \t", 22: items[5].upper()}
    docs = {}
    for m in range(1, 16):
        words = items[m].split()
        for changed in (0, 1, 2):
            some = list(words)
            for at in rng.sample(range(m), min(changed, m)):
                some[at] = "other"
            docs[len(docs)] = f"{cases.sentence(rng, 5, 100_000)} {' '.join(some)}\n{cases.sentence(rng, 4, 100_000)}"
        docs[len(docs)] = " ".join(words[:-1])
        docs[len(docs)] = " ".join(words)
    docs |= {900: None, 901: "", 902: "zz " * 3000}
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = find_passages(cases.documents(spark, rows=list(docs.items())), table, broadcast_seeds=limit).collect()
    want = cases.passages(docs, items)
    assert {(r.doc_id, r.item_id): (r.best_window, r.matched) for r in found} == want
    assert {j for _, j in want} == {*range(1, 16), 22}
    connection = duckdb.connect()
    cases.documents(spark, rows=list(docs.items())).write.parquet(f"{tmp_path}/documents")
    table.write.parquet(f"{tmp_path}/benchmark")
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert {(d, i): (s, t) for d, i, s, t in connection.execute(catalogue.ORACLES["op9_spaced_seeds"]).fetchall()} == want


def test_masks_meet_every_pair_of_replaced_words():
    for a in range(13):
        for b in range(13):
            assert any(not {a, b} & {o + i for i in mask} for mask in MASKS for o in range(13 - mask[-1]))


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pairs(request):
    ranks = read_ranks(public_tokenizers.path(request.param))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return BytePairs(ranks, cached=500), library


@given(st.text(max_size=60) | st.text("ab ", max_size=200) | st.text("aé́ \n日\U0001f600's1", max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_merges(pairs, text):
    import regex

    own, library = pairs
    ids = np.frombuffer(own.encode(regex.findall(public_tokenizers.PATTERN, text)), np.int32)
    half = len(ids) // 2
    assert ids.tolist() == library.encode_ordinary(text)
    assert b"".join(own.decode(ids, np.array([0, half, half, len(ids)])).to_pylist()) == text.encode()


def test_op10_query(spark, sf_dir, sql):
    ranks = read_ranks(public_tokenizers.path(RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in table_texts(sql).items():
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(text or ""))
    assert {r[0]: tuple(r)[1:] for r in catalogue.QUERIES["op10_byte_bpe"](spark, sf_dir).collect()} == want


def test_licences(spark):
    changed = TEMPLATES["MIT-text"].replace("free of charge", "at no charge")
    rows = [
        (1, "text before\n" + TEMPLATES["Apache-2.0"] + "\nand after"),
        (2, TEMPLATES["GPL-3.0"].upper()),
        (3, "x\n" + changed),
        (4, "the licence of poets is not a licence notice at all"),
        (5, "nothing here"),
        (6, TEMPLATES["CC-BY-NC-4.0"] + "\n1\n2\n3\n4\n" + TEMPLATES["MIT"]),
    ]
    found = scan_licenses(cases.documents(spark, rows=rows)).collect()
    got = sorted((r.doc_id, r.first_line, r.license or "", r.verdict) for r in found)
    assert got == [
        (1, 1, "Apache-2.0", "exact"),
        (2, 0, "GPL-3.0", "exact"),
        (3, 1, "MIT-text", "near"),
        (4, 0, "", "none"),
        (6, 0, "CC-BY-NC-4.0", "exact"),
        (6, 5, "MIT", "exact"),
    ]


def test_each_template_wins_on_its_own_text():
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert [(f["license"], f["verdict"]) for f in scanner.scan(text)] == [(name, "exact")]


def test_op8_query(spark, sf_dir, sql):
    scanner = Scanner(TEMPLATES)
    want = [(i, f["first_line"], f.get("license"), f["verdict"]) for i, t in table_texts(sql).items() for f in scanner.scan(t or "")]
    found = catalogue.QUERIES["op8_conditional_compression"](spark, sf_dir).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.first_line, r.license, r.verdict)) for r in found)


def test_pipeline(spark, sf_dir, sql, tmp_path):
    """Each stage against a plain version over what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = dict(sql.execute("SELECT item_id, text FROM benchmark").fetchall())
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if name == "quality_rules":
            want = {r[0] for r in catalogue.QUERIES["op3_risk_controlled"](spark, sf_dir).where("kept").select("doc_id").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
        elif name == "line_dedup":
            want = {i: text for i, (_, _, text) in cases.line_dedup(before).items()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert docs.where("n_chars <> char_length(text)").count() == 0
        elif name == "near_duplicates":
            want = {i for i, (_, least) in cases.classes(before).items() if least == i}
            assert {r.doc_id for r in docs.collect()} == want
        elif name == "decontamination":
            gone = {i for i, _ in cases.passages({i: t for i, t in before.items() if len(t) < 3000}, items)}
            left = {r.doc_id for r in docs.collect()}
            assert {i for i, t in before.items() if len(t) < 3000} - left == gone
        else:
            assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == {i: cases.sha(t) for i, t in before.items()}


def test_find_passages_sends_only_seeds(spark, sf_dir):
    assert "CartesianProduct" not in plan(catalogue.QUERIES["op9_spaced_seeds"](spark, sf_dir))


def test_encode_documents_returns_ids_and_bytes(spark):
    rows = encode_documents(cases.documents(spark)).collect()
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in cases.texts().items()}


@pytest.mark.parametrize("large", [1, 3, 40])
def test_repeats_of_a_passage_in_many_surroundings(spark, large):
    """Shared passages, whole and in pieces, each time between other words; grams are split down to single windows."""
    rng = random.Random(9)
    shared = cases.sentence(rng, 60, 9000)
    texts = {}
    for i in range(90):
        cut = shared[rng.randrange(len(shared) // 2) :] if i % 3 else shared
        texts[i] = cases.sentence(rng, rng.randrange(30), 9000) + " " + cut[: rng.randrange(90, len(cut))] + cases.sentence(rng, 9, 9000)
    texts[90] = "again and again " * 60
    found = remove_repeats(cases.documents(spark, rows=list(texts.items())), large=large).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in found} == cases.repeats(texts)


def test_contexts_are_halved_in_proportion(spark):
    """Many different surroundings of one passage make a few rows each, not one for every window."""
    from textpairs.llm import repeats

    rng = random.Random(10)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(int(i), f"{rng.random():.17f} {passage} {rng.random():.17f}".encode()) for i in range(3000)]
    at = 60
    data = [(text[10 : 10 + 184], at, i, 0, 10) for i, text in rows]
    contexts = spark.createDataFrame(data, "context binary, at int, key bigint, body bigint, lo bigint")
    small, halved = repeats._small_groups(contexts, 500)
    n = small.count() + sum(h.count() for h in halved)
    assert halved and n < 12 * len(data)
    assert small.groupBy("group").count().agg({"count": "max"}).first()[0] <= 500
