"""Page extraction, conversation repair and resampling against plain versions; ids in every operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from factloom.llm import conversation_repair, html_extract, jaccard_join, language_id, packing, resampling, suffix_dedup, toxicity
from factloom.llm.html_extract import main_text

PAGES = [
    ("<article><h1>T</h1><p><b>x  y.<br><p>z &amp; &lt;w&gt; &amp</article><footer>&copy; f", "T\nx y.\nz & <w> &"),
    ("<nav><ul><li>a<li>b</ul></nav><div class=ad><p>q, r. s, t. u, v.<p>r</div><main><header><h1>H</h1></header><div><p>One.</p><pre>a  b\n c</pre></div></main>", "H\nOne.\na b c"),
    ("<p>a<script>var x='</p>'</script>b <svg><path d=1/><g>t</g></svg>c<button>no</button> d</p><p>e<span hidden>zz</span>f</p>", "ab c d\nef"),
    ("<table><tr><td>one, two. three four five<td>six<tr><td>seven</table>", "one, two. three four five\nsix\nseven"),
    ('<body class="x"><div id="header">Site. Name.</div><div class="cookie-notice">We use cookies, ok? Yes, we do.</div><div class="content-with-sidebar"><h1>Title</h1>'
     "<p>First, with <a href=x>a link</a>.<p>Second, longer, much longer, than others were.<ul><li>one<li>two</ul><p>Short.</div>"
     '<section id="comments"><p>Nice article, I liked it, very much, so much indeed, it is long, longer than all.</p></section>', "Title\nFirst, with a link.\nSecond, longer, much longer, than others were.\none\ntwo\nShort."),
    ("<article>a<article class='reader comment'>b</article><form><p>c</p></form><aside>d</aside></article>", "a"),
    ('<div class="text"><p>Long text, with commas, and more. Yes, more.</p></div><div class="text"><p>Short one, too.</p></div>', "Long text, with commas, and more. Yes, more.\nShort one, too."),
    ("a < b & c", "a < b & c"), ("plain  text\n only", "plain text only"), ("<script>x", ""), ("<!-- ", ""), ("<div class=ad>x</div>", ""), ("", ""), (None, ""),
    ("<div>" * 3000 + "x", "x"), ("<p>" + "w, " * 50000, ("w, " * 50000).strip()),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_main_text(i):
    assert main_text(PAGES[i][0]) == PAGES[i][1]


def test_extract_keeps_rows_and_ids(spark):
    rows = [((1 << 60) + 1, "u", PAGES[0][0], "x"), (None, None, None, "x"), ((1 << 60) + 1, "u", PAGES[0][0], "x"), (-5, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = Counter([((1 << 60) + 1, "u", PAGES[0][1], len(PAGES[0][1]))] * 2 + [(None, None, "", 0), (-5, "v", "", 0)])
    assert Counter(map(tuple, html_extract.extract(df).collect())) == want
    assert html_extract.extract(df.where("false")).count() == 0


def plain_repairs(rows):
    """Cheapest edits as least (cost, audit) pairs, every insertion tried."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        own = convs[c]
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        own += [(t, "user" if fate == 4 else r, x)] * {0: 0, 3: 2}.get(fate, 1)
    then = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = []
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1][:64], z[2][:64], hashlib.sha256(f"{len(z[1])}:{z[1]}:{z[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, r, x in own:
            core = x.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not core else "d" if (r, x) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((r, x))
        n, best = len(own), {}
        for i in range(n, -1, -1):
            for more in (0, 1, 2):
                for s in range(4):
                    ways = [(0, "")] if i == n and s in (0, 3) else []
                    if i < n:
                        extra = 3 * (faults[i] == "t")
                        moves = [(4, "D", s)]
                        if faults[i] in ("", "t"):
                            moves += [(extra, "K", after[s, own[i][1][:1]])] if (s, own[i][1][:1]) in after else []
                            moves += [(3 + extra, "R", then[s][1])]
                        ways += [(p + best[i + 1, t, 2][0], e + best[i + 1, t, 2][1]) for p, e, t in moves]
                    if more:
                        ways.append((3 + best[i, then[s][1], more - 1][0], "I" + best[i, then[s][1], more - 1][1]))
                    best[i, s, more] = min(ways, default=(10**9, ""))
        cost, audit = best[0, 0, 2]
        s, i, lines = 0, 0, []
        for e in audit:
            if e in "KR":
                lines.append(f"{own[i][1] if e == 'K' else then[s][0]}:{own[i][2]}")
            if e == "I":
                lines.append(then[s][0] + ":")
            s = s if e == "D" else after[s, own[i][1][:1]] if e == "K" else then[s][1]
            i += e != "I"
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def test_repairs_match_plain_versions(spark):
    """Small conversations, ids beyond 2 ** 53 and null, and one with most of the rows, over several pieces."""
    rnd, rows = random.Random(5), []
    texts = ["Hi.", "yes", "no!", " ", "", "a. \n", None, "é?"]
    for c in [*range(-2, 40), None, 2**60 + 1, 2**60 + 2]:
        for k in range(rnd.randrange(0, 9)):
            rows.append((c, rnd.choice([None, k, k, k, k + 1, k * 3]), rnd.choice(["user", "assistant", "user", "system", "tool", "", "agent", None]), rnd.choice([*texts, "x " * 40 + str(k)])))
    for k in range(900):
        rows.append((777, rnd.choice([None, k, k // 2, 5]), rnd.choice(["user", "assistant", "system"]), rnd.choice(["Hi.", "yes", " ", f"t{k}.", f"u{k}"])))
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece long, conv long").repartition(5)
    assert Counter(map(tuple, conversation_repair.audited(df).collect())) == plain_repairs(rows)
    assert conversation_repair.audited(df.where("false")).count() == 0


def plain_resampled(docs, target):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    have = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in have for b in f), Counter(b for x in target for b in found(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in have:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_matches_a_plain_version(spark, monkeypatch):
    rnd = random.Random(3)
    some = ["Alpha", "beta", "gamma7", "éé", "d-e", "ΑΒ", "zeta"]
    docs = [(k, " ".join(rnd.choices(some, k=rnd.randrange(0, 60)))) for k in range(60)]
    docs += [(2**60 + 1, "beta " * 30), (2**60 + 2, "beta " * 30), (None, "gamma7, beta! " * 20), (5, docs[5][1]), (70, None), (71, ""), (72, "--- ..."), (73, "w" * 3000), (74, " ".join(rnd.choices(some, k=9000)))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank long, own long").repartition(3)
    target = spark.createDataFrame([("beta beta gamma7",), (None,), ("Alpha d",)], "text string")
    want = plain_resampled(docs, ["beta beta gamma7", None, "Alpha d"])
    assert Counter(map(tuple, resampling.resample(df, target).collect())) == want
    cut = resampling.chunks
    monkeypatch.setattr(resampling, "chunks", lambda texts, grams: cut(texts, grams, words=7, chars=40))  # nearly every text in chunks
    assert Counter(map(tuple, resampling.resample(df, target).collect())) == want
    assert resampling.resample(df.where("false"), target).count() == 0


IDS = [(1 << 60) + 1, (1 << 60) + 2, None, -(1 << 60) - 1, 7, None]


def test_ids_stay_exact_beside_nulls(spark):
    """Ids around 2 ** 60, negative ones and nulls in one batch."""
    same = "one passage that stands in two of the texts, and is long enough to be cut from the later one"
    texts = [same, same + " too", "another text", "yet another text of a few words, it says", "seven", None]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in zip(IDS, texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    want = Counter(IDS)
    table = language_id.profiles(docs.where("doc_id IS NOT NULL"))
    net = toxicity.train(["bad words here", "good words there"] * 4, [1, 0] * 4)
    for df in (suffix_dedup.dedup(docs), language_id.predict(docs, table), toxicity.score(docs, net)):
        assert Counter(r["doc_id"] for r in df.collect()) == want and dict(df.dtypes)["doc_id"] == "bigint"
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == set(IDS)
    members, _ = jaccard_join.join(docs)
    parts = {r["doc_id"]: r["component_id"] for r in members.collect() if r["doc_id"] is not None}
    assert parts == {i: i for i in IDS if i is not None} | {IDS[1]: IDS[0]} or parts == {i: i for i in IDS if i is not None}
    near = spark.createDataFrame([(i, "a b c d e f g h", "s") for i in IDS], "doc_id long, text string, source string").coalesce(1)
    assert {r["component_id"] for r in jaccard_join.join(near)[0].collect()} == {IDS[3]}
    assert [r["doc_id"] for r in jaccard_join.representatives(near).collect()] == [IDS[3]]
    apart = spark.createDataFrame([(i, f"{k} b c d e f {k} g h", "s") for k, i in enumerate(IDS)], "doc_id long, text string, source string").coalesce(1)
    assert Counter(r["doc_id"] for r in jaccard_join.representatives(apart).collect()) == want
