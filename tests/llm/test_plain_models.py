"""Language profiles, site quality and toxicity against plain versions, with nulls, ties, repeated rows and clashing columns."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import language_id, site_quality, toxicity


def plain_grams(text: str) -> Counter:
    """1- to 3-grams of the lower-case letters, a run of anything else being one space; none is a space alone or has one in its middle."""
    out, line = Counter(), " "
    for c in text.lower():
        line += c if c.isalpha() else " " if line[-1] != " " else ""
    line = line if line[-1] == " " else line + " "
    for n in (1, 2, 3):
        for k in range(len(line) - n + 1):
            g = line[k : k + n]
            if g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out if line.strip() else Counter()


def code(gram: str) -> int:
    n = 0
    for c in gram:
        n = n << 21 | (1 if c == " " else ord(c))
    return n


def order(counts: Counter, top: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def test_language_id_equals_plain_rank_order_profiles(spark):
    known = [
        (1, "the cat sat on the mat and the dog", "en"), (2, "il gatto è sul tappeto e il cane", "it"), (3, "der Hund und die Katze 😀 schön", "de"),
        (4, "the the the", "aa"), (5, "the the the", "bb"), (6, None, "en"), (7, "lost", None), (None, "unknown id", "en"),
    ]
    top = 40
    docs = spark.createDataFrame([(i, t, v, 1, 2.0) for i, t, v in known], "doc_id long, text string, lang string, score int, rank double")
    profile = language_id.profiles(docs, top)
    totals = defaultdict(Counter)
    for i, t, v in known:
        if i is not None and t is not None and v is not None:
            totals[v] += plain_grams(t)
    want = {v: order(c, top) for v, c in totals.items()}
    assert {v: [int(g) for g in p.sort_values("rank")["gram"]] for v, p in profile.groupby("lang")} == {v: [code(g) for g in gs] for v, gs in want.items()}
    asked = ["the dog and the cat", "the the", "il cane", "Der schöne Hund", "ǅ ﬁ 𝒜b", "12 34", "", None, "the cat " * 3000]
    rows = [(None if k == 2 else k // 2, t, "xx", 9, 3.0) for k, t in enumerate([*asked, asked[0]])]
    got = language_id.predict(spark.createDataFrame(rows, docs.schema), profile, top).collect()
    expected = []
    for i, t, *_ in rows:
        own = order(plain_grams(t or ""), top)
        if not own:
            expected.append((-1 if i is None else i, "und", 0.0))
            continue
        off = {v: sum(abs(gs.index(g) - k) if g in gs else top for k, g in enumerate(own)) for v, gs in want.items()}
        best = min(sorted(off), key=off.get)  # "aa" and "bb" tie: the first by name
        expected.append((-1 if i is None else i, best, round(1 - off[best] / (top * len(own)), 9)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(expected)
    assert "aa" in {e[1] for e in expected} and "bb" not in {e[1] for e in expected}


def test_site_quality_equals_a_plain_empirical_bayes(spark):
    r = np.random.default_rng(3)
    word = ["alpha", "Beta", "gamma", "DELTA", "$$$", "##", "omega"]
    rows = []
    for i in range(400):
        host = str(r.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.15, 0.05]))
        bad = host == "b" or r.random() < 0.2
        text = " ".join(r.choice(word, int(r.integers(0, 40)), p=[0.1, 0.1, 0.1, 0.2, 0.3, 0.1, 0.1] if bad else [0.3, 0.1, 0.3, 0.05, 0.05, 0.0, 0.2]))
        rows.append((i, text if i % 37 else None, str(r.choice(["en", "fr"])), host if i % 41 else None, int(not bad), 5))
    rows.append(rows[10])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, n int")
    labels = spark.createDataFrame([(x[0], x[4]) for x in rows[:300]], "doc_id long, quality int")
    got = site_quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    _, _, rate = site_quality.fit(docs, labels)
    e, hosts, paths = [x["evidence"] for x in got], defaultdict(list), defaultdict(list)
    for x in got:
        hosts[x["host"]].append(x["evidence"])
        paths[x["host"], x["path"]].append(x["evidence"])

    def strength(groups: dict, around) -> float:
        within = max(1e-6, sum(sum((v - np.mean(g)) ** 2 for v in g) if groups is paths else sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups.values()) / max(1, len(e) - len(groups)))
        between = max(1e-6, (sum(len(g) * (np.mean(g) - around(k)) ** 2 for k, g in groups.items()) - within * len(groups)) / len(e))
        return min(1e6, max(1.0, within / between))

    mean = float(np.mean(e))
    k_host = strength(hosts, lambda _: mean)
    host_q = {h: (sum(g) + k_host * mean) / (len(g) + k_host) for h, g in hosts.items()}
    k_path = strength(paths, lambda k: host_q[k[0]])

    def logit(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    for x in got:
        g, h = paths[x["host"], x["path"]], host_q[x["host"]]
        others = (sum(g) - x["evidence"] + k_path * h) / (len(g) - 1 + k_path)
        want = 1 / (1 + math.exp(-(logit(x["evidence"]) - logit(rate) + logit(others))))
        assert x["host_quality"] == pytest.approx(h, abs=1e-9) and x["path_quality"] == pytest.approx((sum(g) + k_path * h) / (len(g) + k_path), abs=1e-9)
        assert x["quality"] == pytest.approx(want, abs=1e-9) and x["kept"] == (x["quality"] >= 0.5)


def test_toxicity_gradients_and_frames(spark):
    net = toxicity.Net({"one": 1, "two": 2}, 0)
    r = np.random.default_rng(1)
    words = ["one", "two", "three", "four"]
    local, mask = r.integers(0, 4, (6, 5)), np.arange(6)[:, None] < np.array([6, 1, 3, 6, 2])[None, :]
    inside = mask & (np.arange(6)[:, None] >= np.array([0, 0, 1, 2, 1])[None, :])
    y = np.array([1.0, 0, 1, 0, 1])
    x = net.inputs(words)
    loss, g, _ = net.gradients(local, mask, inside, x, y)
    for name, d in g.items():
        flat = net.p[name].reshape(-1)
        for k in r.choice(len(flat), min(4, len(flat)), replace=False):
            kept, ends = flat[k], []
            for h in (1e-5, -1e-5):
                flat[k] = kept + h
                ends.append(np.sum(net.gradients(local, mask, inside, x, y)[0]))
            flat[k] = kept
            assert np.reshape(d, -1)[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=2e-5)
    rows = [(1, "one two", 7, 8), (1, "one two", 7, 8), (None, "two", 7, 8), (2, None, 7, 8), (3, " \n", 7, 8), (5, "one " * 5000, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, toxic int")
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert by[1][0] == by[1][1] and by[2][0]["score"] == by[3][0]["score"] == 0
    assert [by[k][0]["held_out"] for k in (None, 2)] == [False, __import__("zlib").crc32(b"2") % 5 == 0]
    assert toxicity.score(docs.where("false"), net).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd)).count() == len(rows)


def plain_windows(net, words):
    """Every window's logit, word by word: states of its tile with its context, softmax over the window."""
    x, p, size = net.inputs(words), net.p, toxicity.HIDDEN
    sig = lambda a: 1 / (1 + np.exp(-a))

    def states(rows, d):
        h, out = np.zeros(size), []
        for row in rows:
            a, g = row @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r = sig(a[:size] + g[:size]), sig(a[size : 2 * size] + g[size : 2 * size])
            n = np.tanh(a[2 * size :] + r * g[2 * size :])
            h = (1 - z) * n + z * h
            out.append(h)
        return np.array(out)

    out, count = [], max(len(words) - toxicity.WINDOW, 0) + 1
    for begin in range(0, count, toxicity.TILE):
        last = min(begin + toxicity.TILE, count)
        low, high = max(begin - toxicity.CONTEXT, 0), min(last - 1 + toxicity.WINDOW + toxicity.CONTEXT, len(words))
        h = np.c_[states(x[low:high], "f"), states(x[low:high][::-1], "b")[::-1]]
        for s in range(begin, last):
            own = h[s - low : min(s + toxicity.WINDOW, len(words)) - low]
            e = np.exp(own @ p["v"])
            out.append((e / e.sum()) @ own @ p["o"] + p["c"])
    return np.array(out)


def test_every_window_is_scored():
    """Texts around the sizes of a window and of tiles, and a passage across the edge of two tiles."""
    net = toxicity.Net({f"w{chr(97 + i)}": i + 1 for i in range(20)}, 3)
    for k in ("v", "o", "E", "C"):
        net.p[k] = net.p[k] * 4
    r = np.random.default_rng(2)
    docs = [[f"w{chr(97 + i)}" for i in r.integers(0, 26, n)] for n in (1, 2, 23, 24, 25, 95, 96, 97, 119, 120, 121, 215, 216, 400)]
    scorer, n = toxicity.Scorer(net), np.array([len(d) for d in docs])
    got = scorer.windows(scorer.rows([w for d in docs for w in d]), n)
    want = [plain_windows(net, d) for d in docs]
    assert got == pytest.approx(np.concatenate(want), abs=1e-4)
    for d, w in zip(docs, want):  # batches of short texts alone too
        assert scorer.windows(scorer.rows(d), np.array([len(d)])) == pytest.approx(w, abs=1e-4)
    worst = toxicity.score_texts(scorer, [" ".join(d) for d in docs] + ["", None])
    assert worst == pytest.approx([1 / (1 + math.exp(-w.max())) for w in want] + [0, 0], abs=1e-4)


def test_a_passage_is_found_wherever_it_starts():
    r = np.random.default_rng(5)
    plain, foul = [f"plain{chr(97 + i)}" for i in range(20)], ["vile", "rotten", "scum", "filth"]
    text = lambda n, at=None: " ".join([*(w := list(r.choice(plain, n)))[: at or 0], *(foul if at is not None else []), *w[at or 0 :]])
    net = toxicity.train([text(60, int(r.integers(0, 60))) if i % 2 else text(60) for i in range(160)], [i % 2 for i in range(160)])
    edge = toxicity.TILE + toxicity.WINDOW
    p = toxicity.score_texts(toxicity.Scorer(net), [text(300, at) for at in range(edge - 40, edge + 8)] + [text(300) for _ in range(20)])
    assert (p[:48] >= 0.5).all() and (p[48:] < 0.5).all()
