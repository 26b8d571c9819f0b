"""Training-data operators against brute force, round trips, held-out accuracy and awkward rows."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of, rows_of_sql, views  # noqa: E402

from tessera import storage  # noqa: E402
from tessera.llm import chat, components, host_rules, langid, license, mixing, ngram_join, packing, pii, queries, shingles, substring_dedup, topk  # noqa: E402

DIR = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (4, "a"), (5, "x" * 20000), (6, "word " * 4000), (7, "1 " * 2000), (8, "😀 é\n\n\n"), (None, "no id here at all")]


def awkward(spark):
    """Null, empty, blank, long and repeated texts, a null id, and columns with names that operators use."""
    rows = [(i, t, "en" if i else None, "h", 1, "clash", 0.5) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")


def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DIR)) == rows_of_sql(views(DIR), queries.ORACLES[name])


@pytest.mark.parametrize("f", [
    pii.pii_report, pii.redact_documents, substring_dedup.dedup_report, lambda d: packing.pack(d, queries.tokenizer_path()), lambda d: ngram_join.jaccard_components(d),
    license.license_report, langid.language_report, host_rules.host_quality, mixing.mix_report,
])
def test_awkward_and_empty_tables(spark, f):
    d = awkward(spark)
    rows = f(d).collect()
    assert len(rows) >= len(AWKWARD)
    assert f(d.limit(0)).collect() == []


def brute_pii(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) >= 5) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(p) <= 255 for p in g.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda g, d: 12 <= len(d) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 9 <= len(d) <= 15),
    }
    out = [(m.start(), k, m.end(), n) for k, (n, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_base_spans(spark):
    extra = ["a@b.c_d@e.f x@y.z.w 1.2.3.4.5.6.7.8 300.1.1.1 0.0.0.00256", "é😀 +49 (0) 30-123456 4111 1111 1111 1111 " + "9" * 5000, "a@b.co.x@y.zz", "+1+2+33333333333", "@@@ a@b a@b.-.c"]
    d = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in pii.pii_report(d).collect():
        want = brute_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
        written = [f"{w[3]}:{w[0]}:{w[2]}" for w in want]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}


def test_pii_model_and_redaction(spark):
    d = spark.createDataFrame([(1, "call tel (555) 123-4567 now, token = \"0123456789abcdef0123\" and mail a.b@c.de."), (2, "version 10.2.33 of 2024-01-02")], "doc_id long, text string")
    one, two = pii.redact_documents(d).orderBy("doc_id").collect()
    assert "[EMAIL]" in one.text and "[PHONE]" in one.text and "[SECRET]" in one.text and "a.b@c.de" not in one.text
    assert two.text == "version 10.2.33 of 2024-01-02"


def test_pii_long_secrets_and_clashing_columns(spark):
    secret, address = "a1B2" * 50, "x" * 90 + " at " + "y" * 80 + "".join(f" dot part{i}" for i in range(6))
    rows = [(1, f"token = {secret} end", "a", 1), (2, f'the api_key: "{secret}==" end', "b", 2), (3, f"mail {address} now", "c", 3), (4, None, "d", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _pii string, pii_spans int")
    made = {r.doc_id: r for r in pii.redact_documents(d).collect()}
    assert made[1].text == "[SECRET] end" and made[2].text == 'the [SECRET]" end' and made[4].text is None
    assert "[EMAIL]" in made[3].text and "part5" not in made[3].text
    assert [(made[i]._pii, made[i].pii_spans) for i in range(1, 5)] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_pii_added_spans_by_kind(spark, monkeypatch):
    """On examples that neither fitting nor calibration saw: recall of 0.7 and precision of 0.9 for every added kind."""
    model, state = pii.fit(spark), random.Random(99)
    monkeypatch.setattr(pii.random, "Random", lambda _: state)
    rows = pii._examples(1500)
    d = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")
    hits = defaultdict(lambda: [0, 0, 0])
    for r in pii.pii_report(d).collect():
        row = rows[r.doc_id]
        found = any(s.split(":")[0] == row["kind"] for s in r.spans.split(","))
        hits[row["kind"]][0] += row["y"]
        hits[row["kind"]][1] += found
        hits[row["kind"]][2] += found and row["y"]
    assert model.trees and set(hits) == {"email", "phone", "id", "iban", "secret"}
    for kind, (good, found, right) in hits.items():
        assert right >= 0.7 * good and right >= 0.9 * found, (kind, good, found, right)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    d = documents(spark)
    rows = packing.pack(d, queries.tokenizer_path(), capacity=512).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in d.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in own] == list(range(0, len(ids), 512)) and sum(p.length for p in own) == len(ids)
        for p in own:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    assert len(sequences) <= -(-sum(r.length for r in rows) // 512) + 2


def test_bin_completion_beats_or_equals_best_fit():
    r = random.Random(3)
    for n in (1, 7, 200, 5000):
        h = defaultdict(int)
        for _ in range(n):
            h[min(256, max(1, int(r.lognormvariate(4, 1))))] += 1
        plan, _ = packing.complete_bins(dict(h), 256)
        used = defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= 256
            for x in pattern:
                used[x] += times
        assert used == h and sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(dict(h), 256))
    assert packing.complete_bins({}, 8) == ([], True)
    assert sum(t for _, t in packing.complete_bins({6: 3, 5: 3, 4: 3, 3: 3}, 9)[0]) == 6


def fewest_bins(items, capacity):
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest():
    r, late = random.Random(1), 0
    for turn in range(600):
        capacity = r.choice((20, 50, 100))
        low, high = (1, capacity) if turn % 2 else (capacity // 5, capacity // 2)
        items = sorted((r.randint(low, high) for _ in range(r.randint(1, 11))), reverse=True)
        h = dict(zip(*np.unique(items, return_counts=True), strict=True))
        h = {int(x): int(n) for x, n in h.items()}
        plan, fewest = packing.complete_bins(h, capacity)
        want = fewest_bins(items, capacity)
        assert fewest and sum(t for _, t in plan) == want >= packing.lower_bound(h, capacity)
        late += sum(t for _, t in packing.best_fit(h, capacity)) > want
    assert late  # best-fit decreasing alone doesn't


def test_chunk_ids_equal_the_whole_tokenizer():
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(queries.tokenizer_path()), random.Random(5)
    memo = packing.ChunkIds(t)
    pool = [*"abcXYZ.,!?;: \n\t'\"-0129", "İ", "ı", "ß", "Σ", "ς", "é", "E\u0301", "\u0307", "ǅ", "ﬁ", "Ⅷ", "中", "😀", "\u200d", "\xa0", "ª", "ñ", "Å", "\x00", "word", "THE", "Öl"]
    for _ in range(30_000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        made = b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" ")))
        assert np.frombuffer(made, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(map(tuple, (w[j : j + k] for j in range(len(w) - k + 1)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    r = random.Random(5)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(60))
    rows, line = [], [word() for _ in range(12)]
    base = [word() for _ in range(70)]
    for i in range(60):  # copies of one text with edits, itself absent; pairs are near the threshold
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60, 120):  # a frequent line in short texts, some texts twice or with one word more
        w = line + [word() for _ in range(r.randrange(1, 30))]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows += [(i + 1000, " ".join(w).upper()), (i + 2000, " ".join([*w, word()]))]
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  B")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(d, shingle=k, percent=percent).collect()} == brute_components(rows, k, percent)


def test_shared_keys_across_batches():
    import pyarrow as pa

    keys = [1, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size], pa.int64()), pa.array(range(a, min(a + size, 10)), pa.int64()), pa.array([0] * len(keys[a : a + size]), pa.int32())], ["key", "id", "spare"]) for a in range(0, 10, size)]
        assert [k for b in ngram_join._shared(iter(batches)) for k in b.column(0).to_pylist()] == [2, 2, 2, 4, 4, 6, 6]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1)], "a long, b long")
    assert {r.id: r.component for r in components.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5}


def test_shingles():
    m = shingles.WordHashes()
    assert len(shingles.shingle_set(b"a b c d a b c", 3, m)) == 4
    assert len(shingles.shingle_set(None, 3, m)) == 0 and len(shingles.shingle_set(b"x", 3, m)) == 1


def test_substring_dedup(spark):
    p = "This passage of words repeats in documents. It has several sentences of some length. The last of them ends here."
    rows = [(3, f"Own words first are these ones. {p} And then own words follow here."), (1, f"Other words begin this document here. {p} It ends in another way entirely."), (2, "One line that is repeated within.\nOne  LINE that is repeated within.\nshort\nshort"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: r for r in substring_dedup.drop_repeats(d, min_run=1).collect()}
    assert made[1].text == rows[1][1] and made[4].text is None
    assert "It has several sentences" not in made[3].text and made[3].text.startswith("Own words first")
    assert made[2].text == "One line that is repeated within.\nshort\nshort"
    for i, t in rows:
        if t:
            kept = "".join(t[a:b] for a, b in zip([0, *(s.end for s in made[i].removed)], [*(s.start for s in made[i].removed), len(t)], strict=True))
            assert kept == made[i].text


def brute_units(text):
    """(normal form, start, end, words): lines, and the sentences of lines that have several, of five words or more."""
    for line in re.finditer(r"[^\n]*\n|[^\n]+$", text):
        a, body = line.start(), line[0].removesuffix("\n")
        sentences = [m for m in re.finditer(r".+?(?:(?<=[.!?])[ \t]+|$)", body)]
        for x, y in [(a, line.end()), *((a + m.start(), a + m.end()) for m in sentences if len(sentences) > 1)]:
            w = text[x:y].lower().split()
            if len(w) >= 5 and len(body.split()) >= 5:
                yield " ".join(w), x, y, len(w)


def brute_dedup(rows, min_run):
    first = {}
    for i, t in sorted(rows):
        for form, *_ in brute_units(t):
            first.setdefault(form, i)
    for i, t in rows:
        seen, lost = set(), []
        for form, a, b, n in brute_units(t):
            if first[form] != i or form in seen:
                lost.append((a, -b, n))
            seen.add(form)
        runs, at = [], -1000
        for a, low, n in sorted(set(lost)):
            if -low > at:
                if a - at > substring_dedup.GAP:
                    runs.append([])
                runs[-1].append((a, -low, n))
                at = -low
        yield i, [(a, b) for run in runs if sum(n for *_, n in run) >= min_run for a, b, _ in run]


@pytest.mark.parametrize("min_run", [1, 20])
def test_substring_dedup_equals_brute_force(spark, min_run):
    rows = [(r.doc_id, r.text or "") for r in documents(spark).collect()]
    want = dict(brute_dedup(rows, min_run))
    assert any(want.values())
    for r in substring_dedup.drop_repeats(documents(spark), min_run=min_run).collect():
        assert [tuple(x) for x in r.removed] == want[r.doc_id]
        text = dict(rows)[r.doc_id]
        cuts = [0, *(x for span in want[r.doc_id] for x in span), len(text)]
        assert (r.text or "") == "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def test_substring_dedup_tells_rows_of_an_id_apart(spark):
    passage = " ".join(f"w{i}" for i in range(30)) + "."
    rows = [(1, passage), (2, f"one two. {passage} tail"), (2, f"ABCDEFG here are other words entirely unrelated. And {passage}\n{passage}"), (2, "short"), (None, passage)]
    d = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, id string, row int")
    made = sorted((r.text, r.id, r.row) for r in substring_dedup.drop_repeats(d).collect())
    assert made == sorted((t, "c", 1) for t in (passage, "one two. tail", f"ABCDEFG here are other words entirely unrelated. And {passage}\n", "short", passage))


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\", "<\\|", "a\\<|b\n<|im_start|>user\n", "", "\\\\<|", "<|" * 3]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", r) for c, r0 in enumerate(nasty) for t, r in enumerate((r0, nasty[-1 - c]))] + [(100, 0, "assistant", None), (101, 0, None, "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chat(d).select("conv_id", "valid", "segments", "formatted", chat.read_back(F.col("formatted")).alias("back")).collect()
    for r in made:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(b.role, b.text) for b in r.back] == want and r.valid == (r.conv_id < 100)
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_chat(d.limit(0)).collect() == []


def test_license_scan():
    m = license.fit()
    assert [x[2] for x in license.scan_text(m, "prose here\nLicensed under the Apache License, Version 2.0.\nmore\nReleased under the MIT License.")] == ["apache-2.0", "mit"]
    assert license.scan_text(m, "You need a license to drive this car and a public version 2.0 of it.\nmit der Zeit") == []
    assert license.scan_text(m, None) == []


def brute_topk(rows, k):
    v = [(i, [int(np.floor(1024.0 * e)) for e in x]) for i, x in rows]
    out = {}
    for q in {i for i, _ in v if i % 100 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in v if j == q for i, y in v if i != q))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_topk_keeps_every_row_and_wide_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    r = np.random.default_rng(2)
    rows = [(int(i), [float(e) for e in r.normal(0, (0.003, 1, 1))]) for i in r.permutation(60)] + [(100, [2.0**43, 1.0, 0.0]), (7, [0.01, 0.5, 0.5]), (7, [0.01, 0.5, 0.5]), (200, [0.0, -(2.0**20), 2.0**-80])]
    d = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<double>, shard int, query_id string")
    made = defaultdict(list)
    for x in topk.exact_topk(d, k=5).orderBy("query_id", "rank").collect():
        made[x.query_id].append((x.vec_id, x.score))
        assert x.rank == len(made[x.query_id])
    assert made == brute_topk(rows, 5) and set(made) == {0, 100, 200}
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_topk(spark.createDataFrame([(0, [4e6, 4e6]), (1, [4e6, 4e6])], "vec_id long, embedding array<double>")).collect()
    assert topk.exact_topk(d.limit(0)).collect() == []


def test_topk_ties_and_faults(spark):
    nan = float("nan")
    rows = [(i, [float(i % 5), 1.0]) for i in range(1, 300)] + [(0, [1.0, 1.0]), (400, None), (401, [nan, 1.0]), (402, []), (403, [None, 1.0]), (404, [1.0]), (500, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.exact_topk(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: [int(1024 * x) for x in v] for i, v in rows if v and len(v) == 2 and None not in v and nan not in v and i != 401}
    for q in (0, 100, 200, 500):
        want = sorted(((i, sum(a * b for a, b in zip(good[q], v, strict=True))) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:10]
        assert got[q] == want
    assert 400 not in got


def test_ball_tree_equals_brute_force_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    r = np.random.default_rng(0)
    x = r.standard_normal((700, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    w = np.floor(1024 * x).astype(np.int64)
    got = {(a.query_id, a.rank): (a.vec_id, a.score) for a in topk.exact_topk(d).collect()}
    for q in range(0, 700, 100):
        s = w @ w[q]
        order = [i for i in sorted(range(700), key=lambda i: (-s[i], i)) if i != q][:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, s[i]) for i in order]


def test_language_gradients():
    r = np.random.default_rng(1)
    net = langid.new_network(["a", "b"], 3)
    net.embed, net.bias, net.cells, net.out, net.out_bias = (p.astype(np.float64) for p in net.params)
    data = langid._columns([b"hello world ab", b"foo"], 16)
    real, label = data != langid.PAD, np.array([0, 1])

    def loss():
        p = langid._taped(net, data)[0]
        return -sum((np.log(p[:, i, k]) * real[:, i]).sum() for i, k in enumerate(label)) / real.sum()

    assert np.allclose(langid._taped(net, data)[0][real], langid.position_probabilities(net, data)[real], atol=1e-5)
    grads = langid._gradients(net, data, label)
    for p, g in zip(net.params, grads, strict=True):
        for at in [tuple(x) for x in np.argwhere(np.abs(g) > 1e-4)[r.integers(0, (np.abs(g) > 1e-4).sum(), 3)]]:
            keep, eps = p[at], 1e-2
            p[at] = keep + eps
            up = loss()
            p[at] = keep - eps
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.collect()}
    rows = [r for r in langid.language_report(d).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_positions_do_not_depend_on_windows_or_neighbours(monkeypatch):
    r = np.random.default_rng(4)
    net = langid.new_network(["a", "b", "c"], 1)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 511, 512, 513, 3000, 40)]
    made = langid.document_probabilities(net, texts)
    for t, p in zip(texts, made, strict=True):
        assert np.allclose(langid.document_probabilities(net, [t])[0], p, atol=1e-5)
        assert abs(p.sum() - 1) < 1e-5
    whole = langid.position_probabilities(net, langid._columns([texts[-1]], 40)).mean(axis=0)[0]
    assert np.allclose(whole, made[-1], atol=1e-5)
    monkeypatch.setattr(langid, "WINDOW", 100)
    assert np.allclose(langid.document_probabilities(net, texts), made, atol=0.02)


def test_language_clashing_columns(spark):
    d = spark.createDataFrame([(1, "abc", "x", 2, "y", 0.5)], "doc_id long, text string, _letters string, _read int, lang_pred string, score double")
    net = langid.new_network(["a"])
    made = langid.identify(d, net).first()
    assert made.asDict() == {"doc_id": 1, "text": "abc", "_letters": "x", "_read": 2, "lang_pred": "a", "score": 1.0}


def test_language_undetermined(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r.lang_pred for r in langid.language_report(d).collect()}
    assert rows[1] == rows[2] == "und"


def test_host_verdicts(spark):
    rows = [("bad", True)] * 300 + [("good", False)] * 300 + [("odd", True)] + [("mixed", i % 2 == 0) for i in range(300)]
    v = {r.host: r for r in host_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean"), "host").collect()}
    assert v["bad"].host_failed and not v["good"].host_failed and not v["odd"].host_failed and not v["mixed"].host_failed
    assert v["odd"].rate < 0.9  # shrunk towards the corpus


def test_host_verdict_changes_documents(spark):
    """A host most of whose documents are symbols loses the others too; one with too few documents doesn't, nor rows without a host."""
    plain = " ".join(f"word{i}" for i in range(30))
    marks = " ".join(f"word{i} #" for i in range(30))
    rows = [(h * 1000 + i, plain, f"h{h}") for h in range(12) for i in range(40)] + [(50_000 + i, marks if i % 10 else plain, "bad") for i in range(200)]
    rows += [(60_000, marks, "tiny"), (60_001, plain, "tiny"), (70_000, marks, None), (70_001, "too short", "h1")]
    made = {r.doc_id: r for r in host_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(made) == len(rows)
    for i, t, h in rows:
        assert made[i].base_failed == (t == "too short") and made[i].kept == (h != "bad" and t != "too short"), (i, h)
    alike = [r.asDict() for r in host_rules.host_quality(spark.createDataFrame([x for x in rows if x[2] != "bad"], "doc_id long, text string, source string")).collect()]
    assert all(r["kept"] != r["base_failed"] for r in alike)


def test_mixture_clashing_columns_and_whole_report(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), "en" if i % 3 else None, f"s{i % 4}", 0.5, True, "t") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _mix_p double, _mix_taken boolean, c0 string")
    report = {r.doc_id: r for r in mixing.mix_report(d).collect()}
    assert len(report) == 200 and all(report[i].tokens == 2 * (1 + i % 7) and report[i].lang_cell == ("en" if i % 3 else "") for i in range(200))
    kept = mixing.sample_mixture(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in report.items() if r.taken}
    assert all(r._mix_p == 0.5 and r._mix_taken and r.c0 == "t" for r in kept.collect())
    share = sum(r.tokens * r.p for r in report.values()) / sum(r.tokens for r in report.values())
    assert abs(share - 0.5) < 1e-6


def test_raking_and_calibration():
    r = np.random.default_rng(0)
    cells = [mixing.Cell((a, b, c), int(r.integers(1, 1000))) for a in "ab" for b in "xy" for c in "mno"]
    targets = [{"a": 0.3, "b": 0.7}, {"x": 0.6, "y": 0.4}, {"m": 0.2, "n": 0.5, "o": 0.3}]
    w = mixing.rake(cells, targets)
    for d, t in enumerate(targets):
        for value, share in t.items():
            assert abs(sum(x for x, c in zip(w, cells, strict=True) if c.key[d] == value) - share) < 1e-6
    tokens = np.array([c.tokens for c in cells])
    p = mixing.calibrate(cells, w, 0.3 * tokens.sum())
    assert abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-6 * tokens.sum() and p.max() <= 1
    assert (mixing.calibrate(cells, w, tokens.sum() * 2) == 1).all()


def test_topic_reads_the_whole_text(spark):
    plain, upper = "some words " * 400, "SOME WORDS " * 400
    rows = spark.createDataFrame([(1, plain + "#|<>" * 2000), (2, upper + "then plain prose " * 10), (3, upper), (4, "#|<> " + plain), (5, None)], "doc_id long, text string")
    topics = {r.doc_id: r.topic for r in rows.select("doc_id", mixing.text_topic(F.col("text")).alias("topic")).collect()}
    assert topics == {1: "markup", 2: "medium", 3: "shouting", 4: "medium", 5: "empty"}


def test_every_value_is_raked(spark, monkeypatch):
    rows = [(100 * i + j, "word " * (i + 1), f"host{i:03}", "en" if (i + j) % 3 else "tr") for i in range(90) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    report = lambda: mixing.mix_report(docs, budget=0.2, targets={"source": {"host003": 0.1}}).orderBy("doc_id").collect()
    small = report()
    assert {r.source_cell for r in small} == {f"host{i:03}" for i in range(90)}
    total = sum(r.tokens for r in small)
    of = lambda h: sum(r.tokens * r.p for r in small if r.source_cell == h)
    # host003 has 8 of 8,190 tokens: its target caps it at probability 1, the others share the rest
    assert of("host003") == 8 and abs(sum(r.tokens * r.p for r in small) - 0.2 * total) < 1e-3
    assert abs(of("host080") / of("host040") - 81 / 41) < 0.01
    monkeypatch.setattr(mixing, "CELLS", 0)  # the same on tables
    assert all(a[:5] == b[:5] and abs(a.p - b.p) < 1e-6 for a, b in zip(small, report(), strict=True))


def test_mixture_meets_its_budget(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_report(d, budget=0.5).collect()
    total, expected = sum(r.tokens for r in rows), sum(r.tokens * r.p for r in rows)
    assert abs(expected - 0.5 * total) < 0.01 * total
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect()}
    assert all(r.tokens == words[r.doc_id] for r in rows)


def test_topk_leaves_the_driver_alone(spark, monkeypatch):
    """Queries and shards meet without a broadcast or an exploded row for each pair, in several waves; the rows are the brute force's."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    plans, write = [], storage._write
    monkeypatch.setattr(storage, "_write", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    r = np.random.default_rng(5)
    rows = [(int(i), [float(e) for e in r.normal(0, 1, 5).round(1)]) for i in r.permutation(900)]
    made = defaultdict(list)
    for x in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        made[x.query_id].append((x.vec_id, x.score))
    assert made == brute_topk(rows, 10) and len(made) == 9
    assert len(plans) > 8 and not re.search("Broadcast|Generate explode", "".join(plans))


def test_topk_counts_copies_besides_the_query(spark):
    """A leaf of equal vectors in which the query's own id comes first and often."""
    rows = [(0, [1.0, 2.0])] * 200 + [(i, [1.0, 2.0]) for i in range(1, 30)]
    got = [(x.query_id, x.rank, x.vec_id) for x in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, i + 1, v) for i, (v, _) in enumerate(brute_topk(rows, 10)[0])] and len(got) == 10


def test_segments_are_counted_where_they_meet(spark, monkeypatch):
    """Bucket sizes and scores come from the pass that deals the rows anyway, not from another shuffle and a join back."""
    plans, write = {}, storage._write
    monkeypatch.setattr(storage, "_write", lambda df, name: plans.setdefault(name, (df.columns, df._jdf.queryExecution().executedPlan().toString())) and write(df, name))
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(8)]
    rows = [(8 * i + j, " ".join([*words[:-1], f"x{i}"] if i else words)) for i in range(4) for j, words in enumerate(base)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(d, shingle=3, percent=90).collect()} == brute_components(rows, 3, 90)
    assert "m" in plans["buckets"][0] and "Join" not in plans["ranked"][1]
    assert [plans[n][1].count("Exchange hashpartitioning") for n in ("buckets", "ranked")] == [1, 1]


def test_ngram_join_leaves_texts_and_keys_where_they_are(spark, monkeypatch):
    """No text is shuffled or joined on its way to its set, and no segment keys are kept besides the shuffle that deals them."""
    plans, write = {}, storage._write
    monkeypatch.setattr(storage, "_write", lambda df, name: plans.setdefault(name, (df.schema.simpleString(), df._jdf.queryExecution().executedPlan().toString())) and write(df, name))
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(8)]
    rows = [(8 * i + j, " ".join([*words[:-1], f"x{i % 3}"] if i else words)) for i in range(6) for j, words in enumerate(base)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(d, shingle=3, percent=90).collect()} == brute_components(rows, 3, 90)
    assert not re.search("Join|Exchange", plans["segments"][1]) and "Join" not in plans["buckets"][1]
    assert [n for n, (columns, _) in plans.items() if "array" in columns] == ["segments"]


def test_ngram_join_bears_ids_found_by_chance(spark, monkeypatch):
    """A bitmap so full that it finds every id, and ids that repeat, lose and add no link."""
    from tessera.llm import id_bitmap

    ids = [3, -7, 2**62, 0, 100]
    bitmap = id_bitmap.id_bitmap(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert id_bitmap.has(bitmap, np.array(ids)).all() and id_bitmap.has(bitmap, np.arange(1000, 2000)).mean() < 0.1
    assert not id_bitmap.has(id_bitmap.id_bitmap(spark.createDataFrame([], "id long")), np.array(ids)).any()
    monkeypatch.setattr(id_bitmap, "MOST_BITS", 64)
    r = random.Random(6)
    base = [[f"w{r.randrange(300)}" for _ in range(50)] for _ in range(6)]
    rows = [(6 * i + j, " ".join([*words[:-1], f"x{i % 4}"] if i % 5 else words)) for i in range(20) for j, words in enumerate(base)]
    twice = [*rows, *rows[:5], (7, "a b c"), (None, rows[0][1])]
    want = brute_components(rows, 3, 90)
    for given in (rows, twice):
        made = ngram_join.jaccard_components(spark.createDataFrame(given, "doc_id long, text string"), shingle=3, percent=90).where("doc_id IS NOT NULL").collect()
        assert len(made) >= len(rows) and {x.doc_id: x.component_id for x in made} == {i: c for i, (_, c) in want.items()}
