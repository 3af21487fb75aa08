import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquarry.llm import chunking, consensus, emails, hashing, leakage, mixing, neardup, truncation

WORDS = "the landlord amended annual ledger of rental pool under protest which insurer had never valued and second appeal was listed".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# p1


MAIL = "Re: Fence AB-1\nFrom: Ann Lee <ann.lee@lee-co.example>\nTo: Bob Ray <bob.ray@ray-trust.example>\nDate: Tue, 02 Jan 2024 10:00:00 +0000\n"


def fresh(body, *known, notices=()):
    m = emails.Message(MAIL + body)
    marks = {8 * k for k, (w, *_) in enumerate(m.sentences()) if any(w == emails.clean(x) for x in known)}
    marks |= {8 * i + 6 for i, line in enumerate(m.lines) if line in notices}
    return [m.lines[i - 1] for i in emails.reduce_email(MAIL + body, marks)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Hi Bob,\nThe survey is late.\n\nRegards,\nAnn Lee\nClaims Adviser\nLee & Co\nTel +00 123 555 0100", ["Hi Bob,", "The survey is late."]),
        ("The survey is late.\n-- \nAnn Lee\nann.lee@lee-co.example\nPS Call me today.", ["The survey is late.", "PS Call me today."]),
        ("Fine by me.\nOn Mon, 1 Jan 2024 at 09:00, Bob\nRay <bob.ray@ray-trust.example> wrote:\n> Dear Ann,\n> shall we\nYes, we shall.\n> meet", ["Fine by me.", "Yes, we shall."]),
        ("Seen.\n-----Original Message-----\nFrom: Bob Ray <bob.ray@ray-trust.example>\nSent: 2024-01-01 09:00\nTo: Ann Lee\nSubject: Fence\nDear Ann,\nOld words.", ["Seen."]),
        ("From: what I recall, the fee was paid.\nOn 23 Jun 2021 Cy Poe wrote: pay $5 or leave. I never replied.\nRegards the rail, it broke.", ["From: what I recall, the fee was paid.", "On 23 Jun 2021 Cy Poe wrote: pay $5 or leave. I never replied.", "Regards the rail, it broke."]),
        ("AL> old\nNew line.\n[attachment: a.pdf]\n", ["New line."]),
        ("Am 05.03.2023 um 05:21 schrieb Bob Ray <bob.ray@ray-trust.example>:\n| Alt.\nNeu.", ["Neu."]),
        ("Dear Ann,\nOld words stand here.\nMany thanks,\nBob Ray\nDear Bob,\nNew words.\nAL", ["Dear Bob,", "New words."]),
        ("", []), ("\n\n", []),
    ],
)
def test_lines_by_layout(body, want):
    assert fresh(body) == want


def test_notices_are_what_is_marked():
    body = "New line.\nRegards,\nAnn Lee\nRegistrar\nKeep this between us two"
    assert fresh(body) == ["New line.", "Keep this between us two"]
    assert fresh(body, notices=("Keep this between us two",)) == ["New line."]


def test_inherited_lines():
    assert fresh("My own words.\nThe old text was pasted here. It goes\non for two lines.", "The old text was pasted here.", "It goes on for two lines.") == ["My own words."]


def test_new_lines(spark):
    schema = "doc_id bigint, parser string, text string, id string"
    first = MAIL.replace("Ann Lee <ann.lee@lee-co.example>\nTo: Bob Ray <bob.ray@ray-trust.example>", "Bob Ray <bob.ray@ray-trust.example>\nTo: Ann Lee <ann.lee@lee-co.example>").replace("02 Jan", "01 Jan") + "The insurer valued the annual ledger of the pool under protest."
    second = MAIL + "We do not agree with any of that at all.\nThe insurer valued the annual\nledger of the pool under protest."
    docs = [(1, "eml", first, "x"), (2, "eml", second, "x"), (3, "eml", None, None), (4, "text", "From: no mail", None), (5, "eml", "", None), (6, "eml", MAIL + "long " * 30000, None)]
    d = spark.createDataFrame(docs, schema)
    t = d.select("doc_id", F.lit(1).alias("page"), "text", F.lit("clash").alias("parser"), F.lit(0).alias("no"))
    got = ids(emails.new_lines(d, t.unionByName(t)), "doc_id", "line_no")
    assert got == [(1, 5), (2, 5), (6, 5)]
    assert emails.new_lines(d.limit(0), t.limit(0)).count() == 0


def test_fingerprints_equal_one_by_one():
    s = ["a b c", "one", "x y z " * 50, "a b d", "ü", ""] * 3
    assert emails.fingerprints(s, slab=5).tolist() == [int(emails.fingerprints([x])[0]) for x in s]


def mails(spark, rows):
    """(doc_id, sender, to, day or None, subject, body[, parent]) as tables."""
    out = []
    for d, a, b, day, subject, body, *parent in rows:
        head = f"{subject}\nFrom: {a.title()} <{a}@{a}-co.example>\nTo: {b.title()} <{b}@{b}-co.example>\n"
        out.append((d, "eml", head + (f"Date: Tue, {day:02d} Jan 2024 10:00:00 +0000\n" if day else "") + body, parent[0] if parent else None))
    d = spark.createDataFrame(out, "doc_id bigint, parser string, text string, parent_doc_id bigint")
    got = emails.new_lines(d, d.select("doc_id", F.lit(1).alias("page"), "text"))
    lines = {r.doc_id: r.text.split("\n") for r in d.collect()}
    return [(i, lines[i][n - 1]) for i, n in ids(got, "doc_id", "line_no")]


NOTICE = "All of our work is done under the usual conditions of trade."


def _company(n=30):
    rng = random.Random(7)
    return [(i, f"s{i % 3}", f"t{i % 7}", 1 + i % 28, f"Matter {i}", text(rng, 9).capitalize() + ".\nRegards,\n" + NOTICE) for i in range(n)]


def test_notices_are_learnt_from_repetition(spark, monkeypatch):
    rows = _company()
    once = (99, "zed", "t1", 3, "Other", "This stands here once only.\nRegards,\nAll of our other work is done in the month of March.")
    near = [(90 + k, f"zed{k}", "t1", 4, f"Else {k}", "My text.\nRegards,\n" + NOTICE.replace(a, b)) for k, (a, b) in enumerate((("usual", "usuall"), ("trade", "trades"), ("work", "worke"), ("of trade", "off trade"), ("All", "Al")))]
    got = mails(spark, [*rows, once, *near])
    assert not [x for x in got if x[1] == NOTICE] and len(got) <= 30 + 2 + 5 + 1  # near ones are found but for one at most
    empty = lambda units: units.select("doc_id", "no").limit(0)
    monkeypatch.setattr(emails, "boilerplate", empty)  # without the pass nothing tells a notice
    assert len([x for x in mails(spark, [*rows, once, *near]) if x[1] == NOTICE]) == 30


def test_pasted_text_is_found_by_its_source(spark, monkeypatch):
    old = "The insurer valued the annual ledger of the pool under protest."
    rows = [
        (1, "bob", "ann", 1, "Fence", "Good. " + old), (2, "ann", "bob", 2, "Re: Fence", "I do not agree at all here.\nGood. The insurer valued the anual ledger of the pool under protest."),
        (3, "cy", "dan", 3, "Gate", "No relation to any of it.\n" + old), (4, "ann", "bob", 5, "New subject", "See what was said before.\n" + old, 1), (5, "ann", "bob", 1, "Late", "Before its parent by the date.\n" + old, 1),
    ]
    monkeypatch.setattr(emails, "boilerplate", lambda units: units.select("doc_id", "no").limit(0))
    got = mails(spark, rows)
    assert [x[0] for x in got if "ledger" in x[1]] == [1, 3] and len(got) == 6  # by conversation, by parent, not by chance
    monkeypatch.setattr(emails, "inherited", lambda units: units.select("doc_id", "no", F.lit(False).alias("short")).limit(0))
    assert [x[0] for x in mails(spark, rows) if "ledger" in x[1]] == [1, 2, 3, 4, 5]


def test_messages_without_a_date_or_sender(spark):
    old = "The insurer valued the annual ledger of the pool under protest."
    two = [(1, "bob", "ann", None, "Fence", old), (2, "ann", "bob", None, "Re: Fence", old)]
    assert [x[0] for x in mails(spark, two)] == [1, 2]  # earlier than none: neither is the other's source
    assert [x[0] for x in mails(spark, [(1, "bob", "ann", None, "Fence", old), (2, "ann", "bob", 2, "Re: Fence", old)])] == [2]
    d = spark.createDataFrame([(1, "eml", "Just a body.\nOf two lines."), (2, "eml", "Subject\nTo: Bob <b@b.example>\nNo sender here.")], "doc_id bigint, parser string, text string")
    assert ids(emails.new_lines(d, d.select("doc_id", F.lit(1).alias("page"), "text")), "doc_id", "line_no") == [(1, 1), (1, 2), (2, 3)]


def test_two_earliest_senders_are_all_that_is_kept(spark):
    rng = random.Random(3)
    rows = [("k", None if at == 50 else at, who) for at, who in ((rng.randrange(40), rng.randrange(9)) for _ in range(200))]
    r = emails.two_earliest(spark.createDataFrame(rows, "k string, at bigint, who bigint"), "k").first()
    first = min((a, w) for _, a, w in rows)
    assert tuple(r.e1) == first and tuple(r.e2) == min((a, w) for _, a, w in rows if w != first[1])


def test_recall_of_near_sentences(spark):
    """Sentences with up to two small edits: the share of what brute force finds within the edit distance."""
    rng = random.Random(12)
    base = [text(rng, rng.randrange(12, 25)) for _ in range(400)]

    def edited(s):
        for _ in range(rng.choice((1, 2))):
            i = rng.randrange(len(s))
            s = rng.choice((s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "z" + s[i + 1 :]))
        return s

    x = emails.with_fingerprints(spark.createDataFrame([(i, s) for i, s in enumerate(base)], "x bigint, text string"), "text")
    y = emails.with_fingerprints(spark.createDataFrame([(i, edited(s)) for i, s in enumerate(base)], "y bigint, text string"), "text")
    got = set(ids(emails.near_texts(x, y, None), "x", "y"))
    assert len({(a, b) for a, b in got if a == b}) >= 0.9 * 400


# p2


def brute_pairs(rows, k, num, den):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows if t is not None for w in [neardup.ASCII_WORD.findall(t.lower())]}
    out = set()
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and den * shared >= num * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def variants(rng, n_base=25):
    rows, i = [], 0
    for _ in range(n_base):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 40, 90, 160]))]
        for _ in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((i, " ".join(w)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, "two words"), (i + 3, rows[0][1].upper() + "!"), (i + 4, "x " * 20000), (i + 5, "x " * 20001)]


@pytest.mark.parametrize("bucket", [1024, 2])
def test_path_join_equals_brute_force(spark, bucket):
    rows = variants(random.Random(8))
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, id string, n int").repartition(3)
    want = brute_pairs(rows, 3, 7, 10)
    found = set(ids(neardup.PathJoin(df, k=3, threshold=(7, 10), bucket=bucket, recall=0.9999).found(), "a", "b"))
    assert not found - want and len(found) >= 0.98 * len(want)


def test_classes(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t), (2, t), (3, t + " thirteen"), (4, "other words that share nothing with them at all here"), (5, None), (1, t)]
    got = ids(neardup.PathJoin(spark.createDataFrame(rows, "doc_id bigint, text string")).classes(), "id", "class_id", "links")
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0)]
    assert neardup.PathJoin(spark.createDataFrame([], "doc_id bigint, text string")).classes().count() == 0


def test_sketch_tells_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:820], rng.integers(0, 2**63, 180).astype(np.uint64)]))
    off = int(np.bitwise_count(neardup.sketch(a) ^ neardup.sketch(b)).sum())
    other = int(np.bitwise_count(neardup.sketch(a) ^ neardup.sketch(rng.integers(0, 2**63, 1000).astype(np.uint64))).sum())
    assert off <= 37 < other


# p3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \né\U0001f600", max_size=6000))
def test_cuts_cover_with_overlap(t):
    c = chunking.cuts(t)
    if not t:
        assert c == []
        return
    assert c[0][0] == 0 and c[-1][1] == len(t)
    assert all(0 < e - s <= 1500 for s, e in c) and all(b[0] == a[1] - 200 for a, b in zip(c, c[1:]))


def test_cuts_end_at_boundaries_and_stay():
    rng = random.Random(2)
    t = " ".join(text(rng, 12).capitalize() + "." for _ in range(150))
    assert all(t[e - 2 : e] in (". ", ".\n") or e == len(t) for _, e in chunking.cuts(t))
    edited = t[:5000] + "Inserted words here. " + t[5000:]
    a, b = ({y[s:e] for s, e in chunking.cuts(y)} for y in (t, edited))
    assert len(a & b) >= len(a) - 3
    assert [e - s for s, e in chunking.cuts("x" * 4000)] == [1500, 1500, 1400]


def test_pieces(spark):
    c = spark.createDataFrame([(1, 9, 5, "A", "x" * 1500, "k"), (2, 9, None, None, "y " * 800, "k"), (3, 9, 0, None, None, "k"), (4, 9, 0, None, "", "k"), (2, 9, None, None, "y " * 800, "k")], "chunk_id bigint, doc_id bigint, char_start int, heading_path string, text string, piece_no string")
    got = chunking.pieces(c)
    assert {r.chunk_id: r.n for r in got.groupBy("chunk_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 4}
    assert got.where("chunk_id = 1").first().char_start == 5
    assert {r.chunk_id for r in chunking.oversized(c).collect()} == {2}
    assert chunking.pieces(c.limit(0)).count() == 0


# p5


def simulated(seed=4, items=400, judges=12):
    rng = np.random.default_rng(seed)
    right = rng.uniform(0.65, 0.97, (judges, 2))
    right[0] = 0.1
    truth = rng.integers(0, 2, items)
    rows = []
    for i in range(items):
        for j in rng.choice(judges, 5, replace=False):
            rows.append((i, f"j{j}", int(truth[i] if rng.random() < right[j, truth[i]] else 1 - truth[i])))
    return truth, right, rows


def test_consensus_finds_truth_and_judges(spark):
    truth, right, rows = simulated()
    m = consensus.Consensus(spark.createDataFrame(rows, "item bigint, judge string, label int"))
    got = {r.item: r for r in m.consensus().collect()}
    votes = np.zeros((400, 2))
    for i, _, v in rows:
        votes[i, v] += 1
    accuracy = np.mean([got[i].consensus == truth[i] for i in range(400)])
    assert accuracy > 0.93 and accuracy > np.mean(votes.argmax(1) == truth)
    rel = {r.judge: (r.right_on_0, r.right_on_1) for r in m.reliability().collect()}
    assert max(abs(rel[f"j{j}"][c] - right[j, c]) for j in range(12) for c in (0, 1)) < 0.15
    three = next(i for i in range(400) if sorted(votes[i]) == [2, 3])
    assert got[three].agreement == pytest.approx(0.4) and got[three].votes == 5


def _difficult(seed=8, items=1500, judges=15):
    """Items each draw towards a wrong label by their own strength; annotators are good."""
    rng = np.random.default_rng(seed)
    skill, truth = rng.uniform(1.5, 3.0, judges), rng.integers(0, 2, items)
    lure = np.where(rng.random(items) < 0.3, rng.normal(3.0, 1.0, items), 0.0)
    rows = []
    for i in range(items):
        for j in rng.choice(judges, 9, replace=False):
            right = rng.random() < 1 / (1 + np.exp(-(skill[j] - lure[i])))
            rows.append((i, f"j{j}", int(truth[i] if right else 1 - truth[i])))
    return truth, rows


def test_item_tilts_are_fitted_and_matter(spark):
    truth, rows = _difficult()
    df = spark.createDataFrame(rows, "item bigint, judge string, label int")
    fitted, without = consensus.Consensus(df, alpha=1.0), consensus.Consensus(df, alpha=1.0, beta=consensus.OFF)
    assert fitted.beta < consensus.BETAS[-1]  # the hidden votes tell that the items differ
    a = {r.item: r.confidence for r in fitted.consensus().collect()}
    b = {r.item: r.confidence for r in without.consensus().collect()}
    assert max(abs(a[i] - b[i]) for i in a) > 0.05
    coins = consensus.Consensus(spark.createDataFrame(simulated(items=1500)[2], "item bigint, judge string, label int"))
    assert coins.beta > fitted.beta


def test_dual_rises_and_equals_its_definition(spark):
    _, _, rows = simulated(seed=5, items=200)
    df = spark.createDataFrame(rows, "item bigint, judge string, label int")
    m = consensus.Consensus(df, alpha=1.0, beta=2.0, tuning=150, tolerance=1e-9)
    assert len(m.dual) > 2 and all(b >= a for a, b in zip(m.dual, m.dual[1:]))
    v = consensus.Votes(np.full(200, 5), np.array([int(np.searchsorted(sorted({r[1] for r in rows}), r[1])) for r in rows]), np.array([r[2] for r in rows]))
    here = consensus.fit_here(v, 12, 2, 1.0, 2.0, 60, 1e-9)
    assert here.dual[-1] == pytest.approx(m.dual[-1], rel=1e-4)
    q, tau, logp, part = v.fit_items(here.sigma[v.judge], here.prior, 2.0)
    by_hand = 0.0
    for j in range(200):
        mine = np.flatnonzero(v.item == j)
        joint = [here.prior[c] * np.prod([np.exp(logp[x, c, v.label[x]]) for x in mine]) for c in range(2)]
        by_hand += np.log(sum(joint))
        assert q[j] == pytest.approx(np.array(joint) / sum(joint))
    assert part == pytest.approx(by_hand - (tau**2).sum())


def test_annotators_beyond_the_bound_as_below(spark):
    _, _, rows = simulated(seed=6)
    df = spark.createDataFrame([(f"i{i}", j, v) for i, j, v in rows], "item string, judge string, label int")
    near, far = consensus.Consensus(df, alpha=1.0, beta=4.0), consensus.Consensus(df, alpha=1.0, beta=4.0, max_annotators=3)
    assert far.far and not near.far and far.dual[-1] == pytest.approx(near.dual[-1], rel=1e-4)
    a, b = ({r.item: r.consensus for r in m.consensus().collect()} for m in (near, far))
    assert a == b
    a, b = ({r.judge: r.right_on_1 for r in m.reliability().collect()} for m in (near, far))
    assert a == pytest.approx(b, abs=0.02) and len(a) == 12


def test_latest_votes(spark):
    h = "array<struct<judge string, judged_at timestamp, verdict boolean>>".replace("judge s", "judge: s").replace("judged_at t", "judged_at: t").replace("verdict b", "verdict: b")
    d = spark.sql("""select 1 as result_id, array(named_struct('judge', ' A', 'judged_at', timestamp'2024-01-01', 'verdict', true), named_struct('judge', 'a', 'judged_at', timestamp'2024-01-02', 'verdict', false),
      named_struct('judge', 'a', 'judged_at', timestamp'2024-01-03', 'verdict', cast(null as boolean)), named_struct('judge', null, 'judged_at', timestamp'2024-01-03', 'verdict', true)) as judge_history union all select 2, null union all select null, array()""")
    assert h and ids(consensus.latest_votes(d.unionAll(d)), "item", "judge", "label") == [(1, "a", 0)]
    empty = consensus.Consensus(consensus.latest_votes(d.limit(0)))
    assert empty.consensus().count() == 0 and empty.reliability().count() == 0


# p6


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"n{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)] + [(30, None), (31, "too short")]
    docs = []
    for d in range(60):
        body = text(rng, 80)
        if d % 3 == 0:
            k = rng.randrange(30)
            n, at = rng.choice([6, 11, 12, 13, 40]), rng.randrange(0, 28)
            w = items[k][1].split()[at : at + n]
            part = " ".join(w).upper().replace("N", "Ｎ", 2).replace("1", "1​")
            body = body[:200] + " " + part + " " + body[200:]
        docs.append((d, body))
    docs += [(100, None), (101, ""), (102, "word " * 150000 + items[0][1]), (103, "Über-\nfluß " + items[1][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, passage string")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    got = set(ids(leakage.leaks(df, it).where("longest_run >= 12"), "item_id", "doc_id"))
    want = set()
    for d, t in docs:
        w = hashing.words(t)
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, p in items:
            pw = hashing.words(p)
            if any(tuple(pw[j : j + 12]) in grams for j in range(len(pw) - 11)):
                want.add((i, d))
    assert got == want and (0, 102) in got and (1, 103) in got
    assert set(ids(leakage.leaks(df, it, block_words=300).where("longest_run >= 12"), "item_id", "doc_id")) == want
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


def test_fold():
    assert hashing.words("Café ﬁn-\n  ish soft­­hyphen Ⅷ a​b") == ["cafe", "finish", "softhyphen", "viii", "ab"]
    assert hashing.words(None) == []


def test_window_simhash_equals_definition():
    h = hashing.hashed([f"w{i}" for i in range(30)])
    for width in (1, 5, 12):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        want = [np.packbits(bits[i : i + width].sum(0) * 2 > width).view(np.uint64)[0] for i in range(31 - width)]
        assert list(hashing.window_simhash(h, width)) == want
        if width % 3 == 0:
            assert list(hashing.window_simhash(h, width, 3)) == want[::3]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 9])
def test_hamming_index_equals_all_pairs(radius):
    rng = np.random.default_rng(radius)
    sims = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    probe = sims[rng.integers(0, 300, 400)].copy()
    for i in range(400):
        for bit in rng.choice(64, int(rng.integers(0, 12)), replace=False):
            probe[i] ^= np.uint64(1) << np.uint64(bit)
    who, which = leakage.HammingIndex(sims, radius).near(probe)
    want = [(i, j) for i in range(400) for j in range(300) if int(probe[i] ^ sims[j]).bit_count() <= radius]
    assert list(zip(who.tolist(), which.tolist())) == want and len(want) > 10


def _edited(rng, words, every):
    return [f"e{rng.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(words)]


def test_near_copies_of_whole_items_need_the_item_sized_windows(spark):
    """Passages with a word in 30 exchanged: the item-sized fingerprints alone find them, and nothing does without windows."""
    rng = random.Random(61)
    items = [(i, " ".join(f"v{rng.randrange(10**5)}" for _ in range(100))) for i in range(60)]
    docs = []
    for d in range(60):
        near = _edited(rng, items[d][1].split(), 30)
        docs.append((d, text(rng, 60) + " " + " ".join(near) + " " + text(rng, 60)))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")

    def share(d, i):
        a = {tuple(x) for x in zip(*[hashing.words(items[i][1])[k:] for k in range(5)])}
        b = {tuple(x) for x in zip(*[hashing.words(docs[d][1])[k:] for k in range(5)])}
        return len(a & b) / len(a)

    want = {(d, d) for d in range(60) if share(d, d) >= 0.8}
    both = leakage.leaks(df, it)
    got = set(ids(both.where("item_share >= 0.8"), "item_id", "doc_id"))
    assert len(want) > 40 and len(got & want) >= 0.9 * len(want) and not got - want
    assert not set(ids(leakage.leaks(df, it, radius=-1, item_radius=-1), "item_id", "doc_id"))
    only = set(ids(leakage.leaks(df, it, radius=-1).where("item_share >= 0.8"), "item_id", "doc_id"))
    assert len(only) >= 0.9 * len(want)
    none = spark.createDataFrame([(1, "x y"), (None, None)], "item_id bigint, passage string")
    assert leakage.leaks(df, none).count() == 0


def test_similarity_gates_the_candidates():
    """What the fingerprints bring up but the shingles don't bear out is not a leak, whatever the gate's bound let through."""
    w = [f"w{i}" for i in range(40)]
    h = hashing.hashed(w)
    index = leakage.ItemIndex([(0, h, np.ones(36, np.float32))])
    mixed = " ".join(w[i + 1] if i % 2 == 0 else w[i - 1] for i in range(40))  # neighbours exchanged: the same words, no shingle
    sims = hashing.window_simhash(hashing.hashed(hashing.words(mixed)), 24, 4)
    assert len(index.levels[1][2].near(sims)[0]) and leakage.scan([mixed], index) == []
    assert leakage.scan([" ".join(w)], index) == [(0, 0, 40, 1.0, 1.0)]


# p7


def test_mix_reaches_shares(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice("aaaaab"), rng.randrange(1, 200), rng.random() * 0.9 + 0.1) for i in range(3000)] + [(5000, None, 9000, 1.0), (5001, "a", 0, 0.05)]
    s = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint, weight double")
    w = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in mixing.plan(s, w).collect()}
    whole = sum(x[2] for x in sizes)
    own = {k: sum(x[2] for x in sizes if x[1] == k) for k in "abc"}
    assert {k: plan[k].capped for k in "abc"} == {k: sh * whole > m * own[k] for k, sh, m in (("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.2, 3))}
    got = {r.doc_id: r for r in mixing.mix(s, w, buckets=16).collect()}
    taken = sum(r.tokens * r.copies for r in got.values() if r.source == "a")
    assert 0 <= 0.3 * whole - taken < 200 and got[5001].copies == 0 and 5000 not in got
    # the fractional pass takes exactly the prefix of the keys' order
    rows = mixing.mix(s, w, buckets=16).join(s.select("doc_id", "weight"), "doc_id").where("source = 'a' and tokens > 0")
    u = (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    order = rows.select((-F.log(u) / F.col("weight")).alias("k"), "doc_id", "copies").orderBy("k", "doc_id").collect()
    copies = [r.copies for r in order]
    assert copies == sorted(copies, reverse=True)
    rep = {r.source: r for r in mixing.report(s, w).collect()}
    assert rep["b"].mixed_tokens == 2 * own["b"] and rep["c"].mixed_tokens == 0 and abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9
    assert mixing.report(s.limit(0), w).first().reached_share is None


def test_sized(spark):
    d = spark.createDataFrame([(1, "a", "two words", None, "x"), (2, None, None, 1, "x"), (3, "a", "", None, "x"), (4, "a", "é ퟿" * 5000, None, "x")], "doc_id bigint, source string, text string, duplicate_of bigint, tokens string")
    got = {r.doc_id: r for r in mixing.sized(d, "/opt/tokenizers").collect()}
    assert got[1].tokens == 2 and got[2].tokens == 0 and got[3].tokens == 0 and got[4].tokens > 5000


# p8


def test_truncation_on_held_out_cuts(spark):
    rng = random.Random(9)
    docs, cut = [], set()
    for i in range(900):
        t = " ".join(text(rng, rng.randrange(6, 14)).strip(".,").capitalize() + "." for _ in range(rng.randrange(4, 60)))
        tail = rng.choice(["", "", "\nPage 3", "\n\nAnn Lee", "\nTotal 20.00"])
        s = rng.choice(["portal", "notes"])
        if s == "portal" and len(t) > 500:
            t, tail = t[:500], ""
            cut.add(i)
        elif rng.random() < 0.05:
            t, tail = t[: rng.randrange(30, len(t) - 5)], ""
            cut.add(i)
        docs.append((i, s, t + tail, "c"))
    extra = [(1000, "notes", None, "c"), (1001, None, "", "c"), (1002, "notes", "  ", "c"), (1003, None, "word " * 50000 + "end.", "c")]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, source string, text string, limit string")
    assert [(r.source_key, r.limit) for r in truncation.find_limits(d).collect()] == [("portal", 500)]
    got = {r.doc_id: r.truncated for r in truncation.detect(d).collect()}
    clear = {i for i in cut if docs[i][2].rstrip()[-1:].isalnum() or docs[i][2].endswith(",")}
    found = {i for i, t in got.items() if t}
    assert got[1000] is None and got[1001] is False and got[1002] is False and got[1003] is False
    assert len(found & clear) > 0.9 * len(clear) and len(found - cut) < 0.05 * len(cut) + 5
    assert truncation.detect(d.limit(0)).count() == 0
    assert truncation.rates(truncation.detect(d.where("doc_id >= 1000"))).count() == 2


def test_ids_with_nulls_stay_whole(spark):
    big = (1 << 60) + 1
    d = spark.createDataFrame([(big, "a", "some text here.", None), (None, "a", "some text here.", None)], "doc_id bigint, source string, text string, duplicate_of bigint")
    assert {r.doc_id for r in mixing.sized(d, "/opt/tokenizers").collect()} == {big, None}
    assert {r.doc_id for r in truncation.detect(d).collect()} == {big, None}
    p = " ".join(f"w{i}" for i in range(20))
    t = spark.createDataFrame([(big, p), (None, p)], "doc_id bigint, text string")
    assert {r.doc_id for r in leakage.leaks(t, spark.createDataFrame([(1, p), (None, p)], "item_id bigint, passage string")).collect()} == {big, None}
    c = spark.createDataFrame([(big, None, 0, None, "x" * 2000), (None, big, 0, None, "x" * 2000)], "chunk_id bigint, doc_id bigint, char_start int, heading_path string, text string")
    assert {(r.chunk_id, r.doc_id) for r in chunking.pieces(c).collect()} == {(big, None), (None, big)}
    assert neardup.PathJoin(t, k=3).found().count() == 0


def test_hot_groups(spark):
    """A third of all rows are copies of one text, a third near-copies of another, a third of one source."""
    rng = random.Random(11)
    hot = " ".join(f"h{i}" for i in range(60))
    near = [f"n{i}" for i in range(120)]
    rows = [(i, hot) for i in range(60)]
    for i in range(60, 120):
        w = list(near)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(50))) for i in range(120, 180)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ids(neardup.PathJoin(df, k=3, threshold=(7, 10), bucket=8, max_depth=4).found(), "a", "b")
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows, 3, 7, 10)
    got = {r.id: r for r in neardup.PathJoin(df, k=3, threshold=(7, 10)).classes().collect()}
    assert got[5].links == 59 and got[5].class_id == 0 and got[100].class_id == 60 and got[150].links == 0


def test_hot_conversation(spark):
    """All messages share one subject; a sentence that all have is boilerplate of no one and inherited by the later ones of other senders."""
    rng = random.Random(44)  # own sentences within the edit distance of each other would be inherited
    rows = []
    for i in range(40):
        s = f"Ann{i % 4} Lee <a{i % 4}@lee-co.example>"
        head = f"Re: One\nFrom: {s}\nTo: Bob Ray <bob@ray.example>\nDate: Tue, {1 + i % 28:02d} Jan 2024 {i // 28:02d}:00:00 +0000\n"
        rows.append((i, "eml", head + f"The insurer valued the common annual ledger under protest.\n{text(rng, 12)} n{i}x."))
    d = spark.createDataFrame(rows, "doc_id bigint, parser string, text string")
    got = ids(emails.new_lines(d, d.select("doc_id", F.lit(1).alias("page"), "text")), "doc_id", "line_no")
    assert {k for k, n in got if n == 6} == set(range(40)) and (0, 5) in got and len([1 for _, n in got if n == 5]) < 10
