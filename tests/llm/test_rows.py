"""Near copies, mixing, archives, neighbours and pages on edge cases and against brute force."""

import base64
import collections
import hashlib
import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.llm import components, extraction, html_blocks, jaccard, mixing, neighbours, tables, warc
from slicewise.llm.lstm import Labeller, padded

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- near copies


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [m for m in members[find(k)] if m is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def copies(seed, families=6, members=12, words=70):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary, 55))
    rows = []
    for _ in range(families):
        base = list(rng.choice(vocabulary, words))
        for _ in range(members):
            text = list(base)
            for at in rng.integers(0, words, rng.integers(0, 5)):
                text[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(text))
    rows += [passage + " " + " ".join(rng.choice(vocabulary, rng.integers(3, 12))) for _ in range(25)]
    rows += [None, "", " \t", "a b", "A  b", "a b", "a b c d", rows[0], rows[0].upper(), "long " * 3000, "long " * 2999]
    ids = list(rng.permutation(len(rows)))
    out = [(int(i), t) for i, t in zip(ids, rows)]
    return out + [(out[0][0], out[0][1]), (None, rows[3]), (out[2][0], "another text with the same id")]


@pytest.mark.parametrize("seed,most", [(1, 1 << 17), (2, 20), (3, 0)])
def test_near_copies_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(jaccard, "FREQUENT", most)
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit("clash"))
    found = jaccard.near_copies(docs).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    # a repeated id with two texts is two documents; the row of an id is compared as a multiset
    assert got == brute_components(rows)


def test_near_copies_deal_out_rows_a_bounded_number_of_times(spark, monkeypatch):
    """Each exchange and each write costs the driver memory, whatever the size of the table."""
    exchanges = []

    def counted(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return tables.stored(df, name)

    monkeypatch.setattr(jaccard, "stored", counted)
    jaccard.near_copies(spark.createDataFrame(copies(1), "doc_id long, text string")).collect()
    assert len(exchanges) <= 24 and sum(exchanges) <= 95


def test_near_copies_of_no_rows(spark):
    assert jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 500, 60)) * 7919 for _ in range(20)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = jaccard.parity_maps(np.concatenate(sets), starts)
    for a, b in itertools.combinations(range(20), 2):
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in maps[a] ^ maps[b])
        assert bits <= len(set(sets[a]) ^ set(sets[b]))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


# ---- mixing


def test_period_keeps_every_source_within_a_block():
    rng = np.random.default_rng(1)
    for _ in range(100):
        parts = {f"s{k}": int(rng.choice([1, 2, 3, 50, rng.integers(1, 300)])) for k in range(rng.integers(1, 10))}
        slots, total = mixing.period(parts), sum(parts.values())
        at = {t: s for s, v in slots.items() for t in v}
        assert sorted(at) == list(range(total))
        done = collections.Counter()
        for t in range(total):
            done[at[t]] += 1
            assert all(abs(done[s] - n * (t + 1) / total) < 1 for s, n in parts.items())
            k = done[at[t]] - 1
            assert k * total // parts[at[t]] <= t < -(-(k + 1) * total // parts[at[t]])


def test_mixture_of_all_rows(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else None, 1) for i in range(900)] + [(i, "t", "small", 1) for i in range(40)]
    rows += [(5, "same", "small", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    weights = {"big": 2, None: 1, "small": 1}
    got = mixing.mix(docs, weights, block=4).collect()
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows)
    assert collections.Counter(r.source for r in got) == collections.Counter(r[2] for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    first = [r for r in got if r.phase == 0]
    slots = {r.slot: r.source for r in first}
    assert sorted(slots) == list(range(len(slots)))
    done = collections.Counter()
    for t in range(len(slots)):
        done[slots[t]] += 1
        assert all(abs(done[s] - w * (t + 1) / 4) < 1.05 for s, w in weights.items())  # weights are rounded to PARTS
    assert mixing.mix(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 1, "small": 1})
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 1, "small": 1, None: 0})


def test_long_schedules_keep_to_unrounded_weights():
    sizes = {"hot": 400_000, **{f"s{k}": 30_000 + 997 * k for k in range(20)}}
    weights = {s: float(n) ** 0.5 for s, n in sizes.items()}
    blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}
    total, done = sum(map(Fraction, weights.values())), collections.Counter()
    seen, worst = 0, 0
    for t, (s, k, phase, slot, release, deadline) in enumerate(mixing.schedule(blocks, mixing.whole_weights(weights))):
        assert slot == t and release <= slot < deadline and k == done[s]
        done[s] += 1
        if phase == 0:
            w = Fraction(weights[s]) / total
            assert release == k / w // 1 and deadline == -(-(k + 1) / w // 1)
            seen = t + 1
            if t % 101 == 0:
                worst = max(worst, *(abs(done[x] - Fraction(weights[x]) / total * seen) for x in sizes))
    assert dict(done) == blocks and seen > 20_000 and worst < 1


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 100)
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 300) AS source")
    got = mixing.mix(docs, 0.5, block=1).collect()
    assert sorted(r.slot for r in got) == list(range(700)) and len({r.doc_id for r in got}) == 700
    assert all(r.release <= r.slot < r.deadline for r in got)
    # sources of equal weights: each phase ends where a source does
    many = {f"s{k}": 1 for k in range(100_000)}
    assert sum(1 for _ in mixing.schedule(many, many)) == 100_000


# ---- archives


def test_archive_round_trip(spark, monkeypatch):
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore"
    pages = [(1, "u", "same"), (2, "u", "same"), (3, "http://x/\r\nEvil: 1", trap), (4, None, None), (5, "u", "")]
    pages += [(6, "ü", "é" * 5000), (None, "u", "no id"), (8, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (9, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, kind string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = {}
    for i, _, h in pages:
        data = (h or "").encode()
        first = last[h or ""]
        revisit = i is not None and first != i
        want[i] = (
            len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "revisit" if revisit else "response", first if revisit else None,
        )
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_no_payload_is_lost_however_pages_are_read(spark):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id") % 50).alias("html"))
    again = pages.unionByName(pages.where("page_id >= 190"))
    for rows, responses, revisits in (
        (pages.repartition(7), 50, 150), (pages.repartition(2), 50, 150), (pages.orderBy(F.rand()), 50, 150), (again.repartition(3), 60, 150)
    ):
        folder = warc.new_folder(spark, "shuffled")
        warc.write(rows, folder)
        kinds = [r.kind for r in warc.read(spark, folder).collect()]
        assert (kinds.count("response"), kinds.count("revisit")) == (responses, revisits)
        bodies = warc.read(spark, folder).where("kind = 'response'").select("body_digest").distinct().count()
        assert bodies == 50


def test_chain_rejects_magic_inside_payloads_at_any_range(spark, tmp_path):
    def record(payload, kind=b"response"):
        return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"

    inner = record(b"inner")
    payloads = [b"a\n" + inner + b"z", inner * 3, b"", b"\n" * 50, b"end"]
    data = b"".join(map(record, payloads))
    (tmp_path / "one.warc").write_bytes(data)
    (tmp_path / "two.warc").write_bytes(record(b"only"))
    want = sorted([*map(len, payloads), 4])
    for span in (7, 64, 1 << 20):
        found = warc.candidates(spark, str(tmp_path), span)
        assert found.count() > len(want)
        got = warc.read(spark, str(tmp_path), span)
        assert sorted(r.length for r in got.collect()) == want
    (tmp_path / "two.warc").write_bytes(record(b"only") + b"rest")
    with pytest.raises(ValueError, match="two.warc"):
        warc.read(spark, str(tmp_path))


def test_archive_with_long_urls(spark):
    trap = "x\nWARC/1.1\r\nWARC-Type: response\r\nX: " + "y" * 200_000 + "\r\nContent-Length: 3\r\n"
    urls = ["u", "data:," + "a" * 100_000, "data:," + "é:" * 400_000, "data:," + "b" * (1 << 16), "v", None]
    pages = [(i, url, f"page {i}") for i, url in enumerate(urls)] + [(90, "w" * 99_999, trap), (91, "x", "page 1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(df).collect()}
    assert got == {i: (len(html), "revisit" if i == 1 else "response") for i, _, html in pages}
    folder = warc.new_folder(spark, "long-urls")
    warc.write(df, folder)
    for span in (1 << 15, warc.RANGE):
        assert sorted(r.uri for r in warc.read(spark, folder, span).collect()) == sorted(url or "" for _, url, _ in pages)


# ---- neighbours


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_are_one_step_apart(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
    key = neighbours.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[100:300] = x[100]  # one vector that is very common
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [], 1), (1040, [0.0] * 12, 1), (1060, [float("nan")] * 12, 1)]
    rows += [(1080, [None] * 12, 1), (1100, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (1120, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    assert set(got) == set(range(0, 700, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        scores = y @ y[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(700), -scores))[:20]
        assert [f[2] for f in found] == list(range(1, 21))
        assert all(abs(scores[i] - s) < 1e-9 for i, s, _ in found)
        assert [s for _, s, _ in found] == sorted((s for _, s, _ in found), reverse=True)
        if 100 <= q < 300:
            assert [i for i, _, _ in found] == best.tolist()  # ties of equal vectors go to smaller ids
        hits += len({f[0] for f in found} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.search(df, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 1): 1, (0, 2): 20, (20, 1): 1, (20, 2): 0}
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


# ---- pages


def test_blocks_of_broken_markup():
    page = (
        "<html><body><!-- <p>no</p> --><script>x='<p>no</p>'</script><div class='menu top'><a href=#>A</a> <a>B</a></div>"
        "<p>one &amp; <b>two<br>three<p>four &lt;x&gt;<ul><li>five<li>six</ul>tail < end"
    )
    got = [(t, [n for n, _ in path]) for t, path, _ in html_blocks.blocks(page)]
    assert [t for t, _ in got] == ["A B", "one & two three", "four <x>", "five", "six", "tail < end"]
    assert got[0][1][-1] == "div" and got[3][1][-2:] == ["ul", "li"] and got[4][1][-2:] == ["ul", "li"]
    assert html_blocks.blocks("") == [] and html_blocks.attribute_words(' class="postBody main-text"') == ("post", "body", "main", "text")


def test_text_after_embedded_elements_is_kept():
    def texts(page):
        return [t for t, _, _ in html_blocks.blocks(page)]

    for icon in (
        "<svg class=i />", "<svg/>", "<svg-icon name=x></svg-icon>", "<svg><path d=M0 /><text>no</text></svg>",
        "<svg><g><g>no</g></g></svg>", "<svg><foreignObject><p>no</p></foreignObject></svg>", "<svg><path>",
        "<div><svg><path>no</div>", "<div><noscript>no</div>", "<span><iframe src=x>no</span>", "<iframe src=x />",
        "<noscript><p>no</p></noscript>", "<script>'<p>no</p>'</script>", "<template><p>no</p></template>",
        "<style/>no</style>", "<style-guide></style-guide>", "<script-x></script-x>",
    ):
        assert texts(f"<body><p>a</p>{icon}<p>b</p></body>") == ["a", "b"], icon
    assert texts("<ul><li>a<noscript>no<li>b</ul><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <math/>here</p>") == ["so x=2 holds here"]
    assert texts("<article><object data=f><p>instead</p></object><p>b</p></article>") == ["instead", "b"]
    assert texts("<p>a</p><script>x<p>no</p>") == ["a"]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = Labeller(5, 3, 1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, lengths = padded([rng.standard_normal((4, 5)), rng.standard_normal((2, 5))])
    y = np.array([[1, 0], [0, 1], [1, 0], [0, 0]], float)
    grads, _ = model.gradients(x, lengths, y)
    for name, w in model.weights.items():
        at, kept = (0,) * w.ndim, w[(0,) * w.ndim]
        losses = []
        for step in (1e-3, -1e-3):
            w[at] = kept + step
            losses.append(model.gradients(x, lengths, y)[1])
        w[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 1e-4


def test_main_text(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(extraction, "SAMPLE", 60)
    pages = tables.documents(spark, sf_dir, "pages")
    odd = spark.createDataFrame([(9001, "u", None), (9002, "u", ""), (9003, "u", "<p")], "page_id long, url string, html string")
    found = {r.page_id: r for r in extraction.extract(pages.unionByName(odd).withColumn("text", F.lit(1))).collect()}
    assert len(found) == pages.count() + 3
    right = 0
    for r in pages.collect():
        blocks = html_blocks.blocks(r.html)
        right += found[r.page_id].text == "\n".join(t for t, path, _ in blocks if extraction.told(path))
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
    assert right >= 0.97 * pages.count()
    assert all(found[i].text == "" and found[i].n_chars == 0 for i in (9001, 9002))


def test_held_out_layouts():
    rng = np.random.default_rng(77)
    model, wrong, total = extraction.train([]), 0, 0
    for _ in range(60):
        x, y = extraction.labelled(extraction.Setter(rng, [], []).page())
        wrong, total = wrong + int((model.labels([x])[0] != (y > 0)).sum()), total + len(y)
    assert wrong <= 0.03 * total
