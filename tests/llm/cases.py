"""Small documents with everything that may go wrong in them, and plain versions of what the operators return."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
CLASHING = "lines body k h1 h2 size slot shard n grams level d0 l0 v0 key m c f e o w at seed kept carried_lang bucket pos".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SQL_SAFE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts(seed=0):
    """Texts by id: blank, long, copied, nearly copied, with shared lines and shared passages."""
    rng = random.Random(seed)
    base = [sentence(rng, 60, 5000) for _ in range(6)]
    near = base[0].split()
    near[30] = "changed"
    shared_line = "One line that many documents hold, in full"
    passage = sentence(rng, 40, 5000)
    out = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "short text of four",
        *base,
        base[0],
        " ".join(near),
        base[1].upper(),
        base[2] + "\n" + shared_line + "\n" + base[3],
        shared_line + "\n" + base[4] + "\n  " + shared_line.upper() + "\t",
        "\n".join([shared_line, sentence(rng, 30, 5000), shared_line]),
        passage + " " + sentence(rng, 50, 5000),
        sentence(rng, 20, 5000) + " " + passage,
        "a" * 5000,
        "Ünïcödé ÉÀ " * 40,
        sentence(rng, 30000, 50000),
        "x y z " * 100,
        "no\xa0break space\x1cseparators " * 9,
    ]
    return dict(enumerate(out))


def documents(spark, clashing=False, rows=None):
    rows = rows if rows is not None else list(texts().items())
    data = [(i, t, ("en", "de", None)[(i or 0) % 3], f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    if clashing:
        for name in CLASHING:
            df = df.withColumn(name, df["doc_id"])
        df = df.withColumn("odd.name`s", df["text"])
    return df


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return (text or "").translate(SQL_SAFE)


def line_dedup(docs, min_chars=10):
    first = {}
    keyed = {}
    for i, text in sorted(docs.items()):
        keyed[i] = [(line, line.strip(SPACES).translate(SQL_SAFE)) for line in (text or "").split("\n")]
        for _, k in keyed[i]:
            first.setdefault(k, i)
    out = {}
    for i, lines in keyed.items():
        kept = [line for line, k in lines if len(k) < min_chars or first[k] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(found, found[1:], found[2:]))
    repeated = set()
    for i, window in enumerate(zip(found, found[1:], found[2:])):
        if windows[window] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        len(lines),
    )


def repeats(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, kept)
    return out


def shingle_set(text, width=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(len(found) - width, 0) + 1))


def classes(docs):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def passages(docs, items, window=13, changed=2):
    out = defaultdict(lambda: (0, 0))
    for i, text in docs.items():
        d = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        for j, item in items.items():
            w = re.findall(r"[^\x20\x09-\x0D]+", fold(item))
            size = min(window, len(w))
            need = size - changed if len(w) >= window else size - (len(w) >= 9)
            if not w:
                continue
            for shift in range(-len(w), len(d)):
                equal = [d[p + shift] == w[p] for p in range(len(w)) if 0 <= p + shift < len(d)]
                sums = [sum(equal[p : p + size]) for p in range(len(equal) - size + 1)]
                if sums and max(sums) >= need:
                    out[i, j] = tuple(map(max, out[i, j], (max(sums), sum(equal))))
    return dict(out)
