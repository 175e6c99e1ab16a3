"""The operators on small tables with nulls, blank and long texts, ties, repeats and no rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from sojourn.llm import decontaminate, language, packing, passages, quality, simhash, tokens, urls, vectors, warc

DOCS = "doc_id long, text string"
RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, shared = prose(300), prose(70)
    near = base.split()
    near[150] = "changed"
    return [
        (5, base),
        (9, base),
        (9, base),
        (7, " ".join(near)),
        (1, prose(90) + "\n" + shared),
        (2, shared + "\t" + prose(60)),
        (3, prose(20) + " " + shared + " " + shared),
        (4, None),
        (6, ""),
        (8, " \n "),
        (10, "one"),
        (11, "One two"),
        (12, " ".join(["same"] * 120)),
        (13, " ".join(["same"] * 80)),
        (None, base),
        (14, prose(30_000)),
    ]


def components(rows):
    fps = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams = [b" ".join(low[k : k + 3]) for k in range(max(1, len(low) - 2))] if low else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i, t] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    group = {f: {f} for f in fps.values()}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    low = lambda f: min((i for (i, _), g in fps.items() if g in group[f] and i is not None), default=None)
    return sorted((str(i), f"{fps[i, t]:016x}", low(fps[i, t])) for i, t in rows)


def test_simhash_equals_brute_force(table, rows):
    found = simhash.near_duplicates(table(rows, DOCS)).select("doc_id", simhash.hexadecimal(), "component_id")
    assert sorted((str(i), f, c) for i, f, c in found.collect()) == components(rows)


def test_simhash_splits_a_crowded_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 900:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    monkeypatch.setattr(simhash, "BLOCK", 64)
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    parent = {f: f for (f,) in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        parent[root(a)] = root(b)
    assert len({root(f) for (f,) in signed}) == 51


def removed(rows, window=50):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages_equal_brute_force(table, rows):
    more = [*rows, (2, prose(40)), (2, prose(55) + " " + rows[0][1])]  # texts that share a doc_id
    found = passages.cleaned(table(more, DOCS)).select(
        "doc_id", "cleaned.n_words", "cleaned.n_removed", "cleaned.kept_sha256"
    )
    got = sorted((str(a), b, c, d) for a, b, c, d in found.collect())
    assert got == removed(more)
    assert sum(r[2] for r in got) > 700


def test_packing_is_gapless_and_exact(table, rows):
    found = packing.pack(table(rows, DOCS)).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want.append((str(i), at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((str(r[0]), *r[1:5]) for r in found) == sorted(want)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 2048), 700)} | {1: 5000, 2048: 3}
    patterns = packing.pack_lengths(histogram)
    got = {}
    for pattern, packs in patterns:
        assert sum(k * v for k, v in pattern.items()) <= 2048
        for k, v in pattern.items():
            got[k] = got.get(k, 0) + v * packs
    assert got == histogram


def test_encoder_equals_the_tokenizer():
    coder = packing.Encoder(packing.default_vocabulary(), most=50)
    parts = ["don't", "O'Neil's.", "x.y", "É.", "naïve,", "3.14.", "<|endoftext|>.", "<|EndOfText|>", "a..", "Straße|"]
    rng = random.Random(5)
    for _ in range(400):
        t = "".join(rng.choice([*parts, " ", "\n", ". ", "\x1c", "…,", "b"]) for _ in range(10))
        assert next(coder.encode_all([t])).tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def letters(n, rng=RNG):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_leaks_exact_and_changed(table):
    item = f"{letters(5)} costs 35 km for Alice until {letters(4)} then 35 km and 7 of Alice {letters(3)}"
    changed = item.replace("35", "48").replace("Alice", "Robert").replace(" 7 ", " 9 ")
    mixed = item.replace("35", "48", 1).replace("35", "52").replace("Alice", "Robert", 1).replace("Alice", "Carol")
    docs = [
        (1, letters(50) + ". " + item + " " + letters(40)),
        (2, letters(10) + "\n" + changed + "\n" + letters(10)),
        (3, mixed),
        (4, letters(100)),
        (5, None),
        (6, ""),
        (1, letters(50)),
        (7, item.replace("35", "48", 1) + " and " + item),
    ]
    items = table([(70, item), (71, letters(20)), (72, None), (73, "a b")], "item_id long, text string")
    found = decontaminate.leaks(table(docs, DOCS), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact"]) for r in found) == [(1, 70, True), (2, 70, False), (7, 70, True)]


def test_quality_tells_noise_from_prose(table, spark):
    rng = random.Random(2)
    docs = [(i, prose(120, rng) if i % 3 else " ".join(w.upper() + "!!" for w in prose(120, rng).split())) for i in range(300)]
    frame = table([*docs, (900, None), (901, ""), (None, "w1")], DOCS)
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int"
    )
    out = quality.scored(frame, quality.train(labels, frame), into="q").collect()
    assert len(out) == 303 and all(0 <= r["q"] <= 1 for r in out)
    assert all((r["q"] >= 0.3) == bool(r["doc_id"] % 3) for r in out if r["doc_id"] in range(200, 300))
    flat = quality.scored(frame, quality.train(labels.limit(0), frame), into="q").collect()
    assert {round(r["q"], 6) for r in flat} == {0.5}


def test_language_profiles(table):
    a, b = "the and of with that ", "der die und nicht schön "
    docs = [(i, (a if i % 2 else b) * 5, "en" if i % 2 else "de") for i in range(20)]
    docs += [(50, None, "en"), (51, "12 !!", None), (52, "жук", None), (53, "The END", None)]
    frame = table(docs, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["language"] for r in language.predicted(frame, language.learn(frame)).collect()}
    assert [found[i]["lang_pred"] for i in (0, 1, 53)] == ["de", "en", "en"]
    assert found[50]["lang_pred"] == found[51]["lang_pred"] == "und"
    assert found[52]["lang_pred"] in ("de", "en") and all(0 <= f["score"] <= 1 for f in found.values())
    none = language.predicted(frame, language.learn(frame.limit(0))).select("language.lang_pred").distinct()
    assert [r[0] for r in none.collect()] == ["und"]


def test_vectors_against_brute_force(table, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 600)] + 0.12 * rng.standard_normal((600, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, x[i].tolist()) for i in range(30)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [None] * 16), (905, [1.0, 2.0])]
    monkeypatch.setattr(vectors, "BLOCK", 8)
    found = {
        r["vec_id"]: r for r in vectors.near_duplicates(table(rows + odd, "vec_id long, embedding array<float>")).collect()
    }
    y = np.array([v for _, v in rows], dtype=float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = y @ y.T >= 0.9
    np.fill_diagonal(true, False)
    n = np.array([found[i]["n_links"] for i, _ in rows])
    assert (n <= true.sum(axis=1)).all() and n.sum() >= 0.95 * true.sum()
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i, _ in odd)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_url_rules_and_native_plan(table):
    rows = [
        (1, "http://a.Example.NET/en/x?q#f"), (2, "https://example.net/de/"), (3, "x://net"), (4, None), (5, "nothing"),
        (6, "http://b.example.com/de/1"), (7, "http://w.org/fr/"), (8, "http://notexample.net/en/"), (9, ""),
        (10, "http://shop.example.com?x"), (10, "http://shop.example.com?x"),
    ]
    out = urls.judged(table(rows, "page_id long, url string"))
    found = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [found[i]["rule"] for i in range(1, 11)] == [
        "example.net/en/", "net/", None, None, None, "example.com/de/", "org/fr/", "net/", None, None
    ]
    assert (found[1]["host"], found[1]["path"]) == ("a.example.net", "/en/x")
    assert (found[10]["host"], found[10]["path"]) == ("shop.example.com", "")
    assert found[5]["host"] == found[4]["path"] == "" and found[4]["verdict"] == "allow"
    assert "Python" not in out._jdf.queryExecution().toString()


def test_warc_round_trip(table):
    long = "<p>é</p>" * 40
    rows = [(3, "http://a/\r\nx", long), (2, None, long), (9, "u", None), (8, "u", "short"), (7, "u", "short"), (None, "u", long)]
    manifest = warc.archive(table(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in warc.read(manifest).collect()}
    assert len(got) == 6
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        2: ("response", None), 3: ("revisit", 2), None: ("revisit", 2),
        9: ("response", None), 8: ("response", None), 7: ("response", None),
    }
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert bytes(got[2]["payload"]) == long.encode() and got[3]["payload"] is None


def test_edits_equal_a_full_recount():
    count = tokens._count(tokens.default_vocabulary())
    rng = random.Random(2)
    parts = ["a", "bc ", " ", "  ", "\n", "x9", "it's", "é ", ". ", "<", "word ", "\t", "12 "]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        starts = tokens.leaves(t, 16)
        tree = tokens.Tree.of([count(t[a:b]) for a, b in zip(starts, [*starts[1:], len(t)], strict=True)])
        assert tree.total == count(t)
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 6)) if len(t) > 6 else [])
        edits = [(a, b, rng.choice(["", "q", " ", "  z", "\n"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        tokens.recount(t, starts, tree, edits, count)
        assert tree.total == count(tokens.edited(t, edits))


def test_token_counts_of_redacted_texts(table):
    rows = [(1, "mail me@x.org or 10.0.0.1 " + prose(400)), (2, None), (3, ""), (4, prose(300) + " 123456789012")]
    out = tokens.recounted(tokens.redactions(tokens.counted(table(rows, DOCS)))).collect()
    count = tokens._count(tokens.default_vocabulary())
    for r in out:
        t = r["text"] or ""
        edits = [(e["start"], e["stop"], e["text"]) for e in r["edits"]]
        assert (r["counts"]["n_before"], r["counts"]["n_after"]) == (count(t), count(tokens.edited(t, edits)))
    assert [len(r["edits"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [2, 0, 0, 1]


def test_empty_tables(table):
    none = table([], DOCS)
    assert simhash.near_duplicates(none).count() == 0
    assert passages.cleaned(none).count() == 0
    assert packing.pack(none).count() == 0
    assert decontaminate.leaks(none, table([], "item_id long, text string")).count() == 0
    assert vectors.near_duplicates(table([], "vec_id long, embedding array<float>")).count() == 0
    assert urls.judged(table([], "page_id long, url string")).count() == 0
    assert warc.read(warc.archive(table([], "page_id long, url string, html string"))).count() == 0
