"""Licence notices planted where lines, blocks and other notices could hide them."""

import random
import textwrap

import cases
import pytest

from textpairs.llm.licenses import TEMPLATES, Scanner, scan_licenses, wording


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


def found(scanner, text):
    return [(f.get("license"), f["verdict"]) for f in scanner.scan(text)]


def times(name, text):
    """Plain word search."""
    own, words = wording(TEMPLATES[name]), wording(text)
    return sum(words[i : i + len(own)] == own for i in range(len(words)))


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("size", [4_000, 80_000])
def test_exact_notice_in_a_long_line(scanner, name, size):
    rng = random.Random(size)
    words = [f"w{rng.randrange(3000)}" for _ in range(size // 5)]
    text = " ".join([*words[: len(words) // 2], TEMPLATES[name], *words[len(words) // 2 :]])
    assert times(name, text) == 1
    assert found(scanner, text) == [(name, "exact")]


@pytest.mark.parametrize("name", TEMPLATES)
def test_notices_on_neighbouring_lines(scanner, name):
    for other in TEMPLATES:
        text = TEMPLATES[name] + "\n" + TEMPLATES[other]
        assert found(scanner, text) == [(name, "exact"), (other, "exact")]


def test_every_notice_of_a_block_and_the_cues_left_over(scanner):
    text = "\n".join(["Copyright of somebody", *TEMPLATES.values(), TEMPLATES["MIT"], " ".join(TEMPLATES.values())])
    want = [*TEMPLATES, "MIT", *TEMPLATES]
    assert found(scanner, text) == [(None, "none"), *((name, "exact") for name in want)]
    changed = TEMPLATES["MIT-text"].replace("free of charge", "at no charge")
    rows = scanner.scan(f"{TEMPLATES['MIT']} {changed} or: {changed}")
    assert [(r["license"], r["verdict"]) for r in rows] == [("MIT", "exact"), ("MIT-text", "near"), ("MIT-text", "near")]
    assert rows[0]["wording"] == TEMPLATES["MIT"].rstrip(".")


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("width", [70, 40, 1])
@pytest.mark.parametrize("sign", ["", "# ", " * "])
def test_wrapped_notice(scanner, name, width, sign):
    lines = textwrap.wrap(TEMPLATES[name], width, break_long_words=False, break_on_hyphens=False)
    text = "\n".join(sign + line for line in ["some words"] * 5 + lines + ["more words"] * 5)
    (row,) = scanner.scan(text)
    assert (row["license"], row["verdict"], row["first_line"], row["n_lines"]) == (name, "exact", 5, len(lines))


def test_texts_with_a_wrapped_cue_reach_the_scanner(spark):
    text = "\n".join(textwrap.wrap(TEMPLATES["Unlicense"], 70))
    (row,) = scan_licenses(cases.documents(spark, rows=[(1, text), (2, "public\ndomain"), (3, "the public of a domain")])).where("doc_id <> 2").collect()
    assert (row.doc_id, row.license, row.verdict) == (1, "Unlicense", "exact")


def test_own_templates_without_a_cue(spark):
    own = {
        "house": "Anyone may copy these pages as often as they like provided that nothing in them is altered",
        "short": "Copyleft applies",
        "words": "Überall frei zu verwenden",
    }
    altered = own["house"].replace("pages", "leaves").replace("altered", "changed")
    rows = [
        (1, "before\n" + own["house"].upper() + "\nafter"),
        (2, altered),
        (3, "copyleft  APPLIES, it says"),
        (4, "hier: überall frei zu verwenden"),
        (5, "pages and pages of provided things that nobody altered"),
        (6, "some unknown license"),
        (7, None),
    ]
    for templates in (own, {k: own[k] for k in ("house", "short")}):
        found = scan_licenses(cases.documents(spark, rows=rows), templates).collect()
        got = sorted((r.doc_id, r.license or "", r.verdict) for r in found)
        want = [(1, "house", "exact"), (2, "house", "near"), (3, "short", "exact"), (4, "words", "exact"), (6, "", "none")]
        assert got == [w for w in want if not w[1] or w[1] in templates]
    assert scan_licenses(cases.documents(spark, rows=rows), {}).where("license is not null").count() == 0


def test_the_ranking_decides_which_template_is_confirmed(monkeypatch):
    wide = "This license lets anyone copy, change and {} the work in any form"
    templates = {"sell": wide.format("sell"), "print": wide.format("print")}
    for first in templates:
        scanner = Scanner(templates)
        order = [first, *(name for name in templates if name != first)]
        monkeypatch.setattr(scanner, "ranked", lambda block, order=order: order)
        assert found(scanner, wide.format("lend")) == [(first, "near")]
        assert [found(scanner, templates[name]) for name in templates] == [[(name, "exact")] for name in templates]


def test_templates_rank_by_the_bytes_they_save(scanner):
    for name, text in TEMPLATES.items():
        ranking = scanner.ranked(f"some words before it {text} and others after it")
        saved = [scanner.reduction(n, f"some words before it {text} and others after it") for n in ranking]
        assert saved == sorted(saved, reverse=True) and ranking[0] == name


def test_no_exact_notice_is_missed(scanner):
    """Notices between random words that resemble them; a plain word search finds none that the scan lacks."""
    rng = random.Random(8)
    pool = [w for t in TEMPLATES.values() for w in t.split()]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts.append(" ".join(rng.choices(pool, k=rng.randrange(1, 25))))
            parts.append(rng.choice(list(TEMPLATES.values())))
        text = rng.choice([" ", "\n"]).join(parts)
        rows = scanner.scan(text)
        got = wording(" | ".join(r["wording"] for r in rows if r["verdict"] != "none"))
        for name in TEMPLATES:
            held = [other for other in TEMPLATES if other != name and times(name, TEMPLATES[other])]
            exact = sum(r.get("license") == name and r["verdict"] == "exact" for r in rows)
            inside = sum(times(name, r["wording"]) for r in rows if r.get("license") in held)
            assert exact + inside == times(name, text), (name, text)
        assert got
