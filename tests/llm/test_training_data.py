"""Training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import answers, form_labels, leaks, mixture, near_copies, page_bodies, queries, rule_lists, site_lines, split_overlap, splitting, subject_areas, text_forms
from sparkloom.llm import textkernel as K

DOCS = "doc_id long, title string, text string, lang string, source string, url string, site string, class string"


def docs(spark, rows):
    """Documents from (doc_id, text[, source, url]), with clashing extra columns."""
    return spark.createDataFrame([(r[0], None, r[1], None, *(list(r[2:]) + [None, None])[:2], "clash", "clash") for r in rows], DOCS)


def sentence(rng, n=8):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi", "chi", "psi", "omega", "kappa"]) + str(rng.randint(0, 40)) for _ in range(n))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# ---- kernel -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé ßÉ​7-\n.日𐐀", max_size=30)), max_size=6))
def test_kernel_words(texts):
    w = K.words(texts)
    for i, t in enumerate(texts):
        flat = re.sub("​", "", K.prepare(t)).lower()
        assert [w.text(j) for j in range(w.first[i], w.first[i + 1])] == re.findall(r"[^\W_]+", flat)
    same = {}
    for j in range(len(w.hash)):
        assert same.setdefault(w.text(j), w.hash[j]) == w.hash[j]


def test_chunks_never_cut_a_text():
    texts = ["x" * 10, None, "y" * 1000, "z"]
    assert [i for a, b in K.chunks(texts, 100) for i in range(a, b)] == [0, 1, 2, 3] or sum(b - a for a, b in K.chunks(texts, 100)) == 4


# ---- 1 ------------------------------------------------------------------------------------------------------------


def test_rules_hold_on_held_out_documents(spark):
    rows = [(i, *x) for i, x in enumerate(form_labels.composed(2400, seed=77))]
    got = {r.doc_id: r.form for r in text_forms.forms(docs(spark, [(i, t) for i, t, _ in rows]), size=1500).collect()}
    rated = {r.id for r in spark.range(2400).orderBy(F.xxhash64("id"), "id").limit(1500).collect()}
    assert np.mean([got[i] == form for i, _, form in rows if i not in rated]) > 0.93  # some of them lie near a half


def test_rater():
    assert form_labels.form("[e1] Mor D. Das Tal (kad). 1951.\n[c2] Tel E. Der Fluss, kad. 1962.") == "list"
    assert form_labels.form("Cached compiler parser merged branch query planner deployed logged patched model index.\nParser cached merged branch query planner deployed logged patched compiler model token.") == "junk"
    assert form_labels.form(None) == form_labels.form("") == form_labels.form("It rained all day, and nobody came.") == "prose"


def test_line_counts_add_up(spark):
    text = "- one Fig\n\n| a | 12 |\nIt rained; 7x and seven, then…\n\u200b \n"
    _, number, counts, _, worded = text_forms.line_counts([text, None, ""])
    assert number.tolist() == [0, 2, 3] and worded.all()
    assert counts["bars"].tolist() == [0, 3, 0] and counts["ended"].tolist() == [0, 0, 1] and counts["digits"].tolist() == [0, 2, 1]
    assert counts["words"].tolist() == [2, 2, 6] and counts["chars"].tolist() == [7, 6, 25]


def test_rule_list_sql():
    x = {"a": np.array([0.0, 0.1, 0.9, 1.0] * 12), "b": np.zeros(48)}
    rules = rule_lists.learn(x, np.array(["n", "n", "y", "y"] * 12), ["y"])
    assert rule_lists.to_sql(rules, "n") == "CASE WHEN a > 0.5 THEN 'y' ELSE 'n' END"
    assert rule_lists.to_sql([], "n") == "'n'"


def test_forms_and_edge_cases(spark):
    plants = "aster birch clover dahlia elder fern gorse hazel iris juniper larch maple".split()
    table = "\n".join(f"| {x} meadow | {i * 37} | {i * 7}% | {x[::-1].title()} |" for i, x in enumerate(plants))
    bullets = "\n".join(f"- {x} {plants[-i]}" for i, x in enumerate(plants))
    log = "\n".join(f"2024-01-01T00:00:{i:02}Z INFO app[{i}]: k={i:08x}" for i in range(12))
    prose = "The cat sat on the mat. It was a fine day, and nobody minded the rain."
    rows = docs(spark, [(1, table), (2, bullets), (3, log), (4, prose), (5, None), (6, ""), (7, "​ \n"), (None, table), (8, prose * 3000), (4, prose)])
    got = {r.doc_id: r.form for r in text_forms.forms(rows).collect()}
    assert got == {1: "table", 2: "list", 3: "junk", 4: "prose", 5: "prose", 6: "prose", 7: "prose", 8: "prose"}
    assert text_forms.document_figures(docs(spark, [])).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    total, holding, seen = Counter(), defaultdict(set), []
    for i, (doc, text, source, url) in enumerate(rows):
        site = (source or "").strip().lower() if not (url or "") or url.startswith("file:") else re.sub(r"^www\.", "", re.sub(r"^\w+://([^/:]*).*", r"\1", url.lower()))
        total[site] += 1
        for n, line in enumerate((text or "").split("\n")):
            key = " ".join(re.findall(r"[^\W\d_]+", line.lower()))
            if key:
                holding[site, key].add(i)
                seen.append((doc, n, site, key))
    ok = {k for k, v in holding.items() if len(v) >= 5 and len(v) * 10 >= total[k[0]]}
    return {(d, n) for d, n, s, k in seen if (s, k) in ok}


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        url = rng.choice(["https://www.A.example:80/x", "http://a.example/y", "https://b.example", "", None, "file:///p"])
        lines = [sentence(rng) for _ in range(3)] + rng.sample(["Share this!", "SHARE  THIS 12", "© 2024 All rights", "Read on…", "12345"], 2)
        rng.shuffle(lines)
        rows.append((i, "\r\n".join(lines), rng.choice(["web", " WEB", None]), url))
    rows += [(500, None, "web", None), (501, "", None, None)]
    assert {tuple(r) for r in site_lines.repeated_lines(docs(spark, rows)).collect()} == brute_lines(rows)


def test_merged_batches_equal_a_full_count(spark, tmp_path):
    rows = [(i, f"unique {chr(97 + i)}{chr(98 + i)} text\nSubscribe now", "web", "https://s.example") for i in range(8)]
    first, second = docs(spark, rows[:4]), docs(spark, rows[4:])
    state = site_lines.LineCounts(spark, f"file://{tmp_path}/state")
    assert state.batches() == [] and state.found().count() == 0
    assert state.touched(state.add("one", first)).count() == 0  # four documents are too few
    version = state.add("two", second)
    assert {r.doc_id for r in state.touched(version).collect()} == set(range(8))  # the line crossed only now, so all its documents change
    assert state.add("one", first) == 1 and state.add("two", second) == 2 and state.batches() == ["one", "two"]  # delivered again
    assert {tuple(r) for r in state.found().collect()} == brute_lines(rows) == {(i, 1) for i in range(8)}
    again = site_lines.LineCounts(spark, f"file://{tmp_path}/state")  # the folder is all there is
    want = {i: f"unique {chr(97 + i)}{chr(98 + i)} text" for i in range(8)}
    assert {r.doc_id: r.text for r in site_lines.cleaned(docs(spark, rows), again.recurring(), state.touched(version)).collect()} == want
    assert {r.doc_id: r.text for r in site_lines.rebuild(docs(spark, rows), again.found()).collect()} == want


def test_lines_that_recur_no_more_touch_their_documents(spark):
    state = site_lines.LineCounts(spark, min_documents=2, min_share=0.5)
    state.add("one", docs(spark, [(i, f"a{i}b\nread more", "web", None) for i in range(2)]))
    version = state.add("two", docs(spark, [(i + 2, f"{chr(97 + i) * 4} text", "web", None) for i in range(6)]))
    assert state.recurring().count() == 0 and {r.doc_id for r in state.touched(version).collect()} == {0, 1}


@pytest.mark.parametrize("share,least", [(0.15, 3), (0.4, 8), (0.7, 14), (0.1, 2), (1, 20)])
def test_shares_are_exact(spark, share, least):
    counts = spark.createDataFrame([(1, i, i) for i in range(1, 21)], "site long, line long, holding long")
    totals = spark.createDataFrame([(1, 20)], "site long, documents long")
    assert {r.line for r in site_lines.recurring(counts, totals, 1, share).collect()} == set(range(least, 21))


# ---- 3 ------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute_pairs(rows):
    sets = {d: shingles(t) for d, t in rows if shingles(t)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_near_copies_match_brute_force_with_a_hot_group(spark):
    rng = random.Random(9)
    rows, base = [], sentence(rng, 90).split()
    for i in range(60):  # a group beyond the length of a list that is paired at once
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, sentence(rng, 60)) for i in range(60)]
    rows += [(200 + i, rows[60 + i][1].upper().replace(" ", ", ")) for i in range(20)]
    rows += [(300, "one two three"), (301, "One, two - three"), (302, "too short"), (303, None), (304, "")]
    got = {tuple(r) for r in near_copies.near_copies(docs(spark, rows)).collect()}
    want = brute_pairs(rows)
    assert len(got & want) >= 0.999 * len(want) and not got - want
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_near_copies_in_hot_groups_of_short_texts(spark):
    rng = random.Random(31)
    rows = []
    for group, n in enumerate((5, 6, 8, 12)):
        base = sentence(rng, n)
        rows += [(1000 * group + i, edited(rng, base, rng.choice((0, 1, 2)) / n) + " " + sentence(rng, rng.randint(0, 2))) for i in range(150)]
    got, want = {tuple(r) for r in near_copies.near_copies(docs(spark, rows)).collect()}, brute_pairs(rows)
    assert len(want) > 1000 and got == want


def test_near_copies_around_the_threshold_in_hot_groups(spark):
    rng = random.Random(32)
    rows = []
    for group, (n, share) in enumerate(((60, 1 / 15), (150, 1 / 15), (300, 1 / 15))):
        base = sentence(rng, n)
        rows += [(1000 * group + i, edited(rng, base, share)) for i in range(150)]
    got, want = {tuple(r) for r in near_copies.near_copies(docs(spark, rows)).collect()}, brute_pairs(rows)
    assert len(want) > 1000 and not got - want
    assert len(got) >= 0.999 * len(want)


def test_groups_of_a_long_chain(spark):
    members = spark.createDataFrame([(i, 1000 + i) for i in range(40)] + [(99, 5)], "class long, doc_id long")
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(39)], "a long, b long, similarity double")
    rows = near_copies.groups(pairs, members).collect()
    assert {r.group_id for r in rows if r.doc_id >= 1000} == {1000} and [r.links for r in rows if r.doc_id == 5] == [0]


# ---- 4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("prompt,response,want", [
    ("Why?", None, ["empty"]), ("Why?", " \n", ["empty"]), ("Why?", "​", ["empty"]), ("Why?", "**", ["empty"]), ("Why?", "[no answer]", ["empty"]),
    ("What is the depth of the lake?", "About 30 metres", []), ("What is the depth of the lake?", "It is deep, and the", ["truncated"]), ("Give code.", "Here:\n```\nx = 1", ["truncated"]), ("Steps?", "Do this.\n1. one\n2.", ["truncated"]),
    ("Steps?", "Do this.\n- one\n- two", []), ("Explain it.", "It works (see", ["truncated"]), ("Who?", "Ada and Grace", []), ("Explain.", "First this. Then th", ["truncated"]),
    ("Tell me.", "I'm sorry, but I can't help with that.", ["refusal"]), ("Tell me.", "Thank you for asking. I must decline to comment on it.", ["refusal"]), ("Tell me.", "I cannot, wrote Ada, and the ship was sold the next day.", []),
    ("Sorgst du dich?", "Dabei kann ich nicht helfen.", ["refusal"]), ("Tell me.", "Sorry is the word she used most in the chapter.", []),
    ("What is the role of the old bridge?", "What is the role of the old bridge?", ["copies_question"]), ("What is the role of the old bridge?", "You asked: “What is the role of the old bridge?”", ["copies_question"]),
    ("What is the role of the old bridge?", "It carries the road over the river.", []), ("Is it true that the old bridge fell in May?", "The old bridge fell in May. Nobody was hurt, and it was rebuilt.", []),
    ("What is the role of the bridge in the town?", "Le pont porte la route sur la rivière, et il est vieux.", ["other_language"]), ("Answer in French: what is the role of the bridge in the town?", "Le pont porte la route sur la rivière, et il est vieux.", []),
    ("What is on the label of the box?", "The label on the box reads “Le pont porte la route sur la rivière” and no more.", []), (None, "It is the one that was there.", []),
])
def test_defects(prompt, response, want):
    assert answers.defects(prompt, response) == want


@pytest.mark.parametrize("response,want", [
    (" " * 50, ["empty"]), ("\n" * 50, ["empty"]), ("\u200b" * 50, ["empty"]), ("<p></p>" * 10, ["empty"]), ("-" * 50, ["empty"]), ("n/a" + " " * 50, ["empty"]),
    ("What is the role of the old bridge? " * 5, ["copies_question"]), ("What is the role of the old bridge? " * 40, ["copies_question"]),
    ("What is the role of the old bridge? " * 5 + "It carries traffic across a river between two large towns.", []),
])
def test_defects_at_any_length(response, want):
    assert answers.defects("What is the role of the old bridge?", response) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=14), st.integers(1, 3))
def test_suffix_automaton_coverage(told, said, least):
    runs = {tuple(told[i:j]) for i in range(len(told)) for j in range(i + 1, len(told) + 1)}
    covered = {k for i in range(len(said)) for j in range(i + least, len(said) + 1) if tuple(said[i:j]) in runs for k in range(i, j)}
    assert answers.SuffixAutomaton(told).covered(said, least) == len(covered)


def test_long_and_repeated_answers(spark):
    rows = [("prompts", 1, "Why?", "It is so. " * 50_000), ("prompts", 1, "Why?", "n/a"), ("prompts", 1, "Why?", "n/a"), (None, None, None, None)]
    got = answers.unsound(spark.createDataFrame(rows, "origin string, pair_id long, prompt string, response string")).collect()
    assert Counter(r.defect for r in got) == {"empty": 3}


# ---- 5 ------------------------------------------------------------------------------------------------------------


def page(rng):
    nav = rng.sample(["Home", "Shop", "Contact", "About us", "Archive", "Login"], 4)
    head = sentence(rng, 4)
    body = [". ".join(sentence(rng, 12) for _ in range(3)).capitalize() + "." for _ in range(rng.randint(2, 5))]
    lines = [*nav, head, *body, "Read also", *[sentence(rng, 4) for _ in range(3)], "© 2024 Site. All rights reserved.", "Back to top"]
    return "\n".join(lines), head, set(range(len(nav), len(nav) + 1 + len(body)))


def test_labeller_learns_page_bodies(spark):
    rng = random.Random(2)
    made = [page(rng) for _ in range(120)]
    rows = [(i, t, h, None) for i, (t, h, _) in enumerate(made)] + [(900, None, None, None), (901, "", "x", None), (902, "404 - not found", None, None), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "page_id long, text string, title string, line_no string")
    found = defaultdict(set)
    for r in page_bodies.main_bodies(df).collect():
        found[r.page_id].add(r.line_no)
    hit = sum(len(found[i] & want) for i, (_, _, want) in enumerate(made))
    assert hit >= 0.95 * sum(len(w) for _, _, w in made) and hit >= 0.95 * sum(map(len, found.values()))
    assert page_bodies.main_bodies(df.limit(0)).count() == 0


def test_network_is_kept_as_bytes():
    network = page_bodies.BiLstm(7, hidden=3)
    again = page_bodies.from_bytes(page_bodies.to_bytes(network))
    x, mask = page_bodies.pad([np.ones((4, 7), np.float32), np.zeros((2, 7), np.float32)])
    assert np.array_equal(network.forward(x, mask)[0], again.forward(x, mask)[0])
    again.p["o"] = again.p["o"][:4]
    with pytest.raises(ValueError):
        page_bodies.from_bytes(page_bodies.to_bytes(again))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = page_bodies.BiLstm(5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = page_bodies.pad([rng.normal(size=(4, 5)), rng.normal(size=(2, 5))])
    y = (rng.random(mask.shape) > 0.5).astype(float)

    def loss():
        z, _ = net.forward(x, mask)
        return float((mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for name, at in (("xf", (1, 2)), ("hf", (0, 4)), ("xb", (3, 7)), ("hb", (1, 1)), ("o", (2,)), ("bb", (5,))):
        step = 1e-3
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3


# ---- 6 ------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    cut = splitting.cuts(text, limit, overlap)
    if not text:
        assert cut == []
        return
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert 0 < b - a <= limit and a < c <= b and b - overlap <= c and d > b
    assert all(b - a <= limit for a, b in cut)


def greedy(text, limit, overlap):
    end, following = splitting.successors(K.code_points(text), limit, overlap)
    at, out = 0, []
    while at < len(text):
        out.append((at, int(end[at])))
        at = int(following[at])
    return out


def test_doubling_equals_following_one_by_one(spark):
    rng = random.Random(5)
    text = "\n\n".join(". ".join(sentence(rng, 9) for _ in range(rng.randint(1, 9))) + "." for _ in range(200))
    assert splitting.cuts(text) == greedy(text, splitting.LIMIT, splitting.OVERLAP)
    rows = splitting.split_long(docs(spark, [(1, text), (2, "short"), (3, None), (4, "x" * 10_000), (5, "y" * 4096), (None, text)])).collect()
    assert {r.doc_id for r in rows} == {1, 4}
    assert all(len(r.text) <= 4096 and r.finish - r.begin == len(r.text) for r in rows)
    parts = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert "".join(p.text[(parts[i - 1].finish - p.begin if i else 0) :] for i, p in enumerate(parts)) == text
    assert all(140 <= p.finish - q.begin <= 200 for p, q in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        splitting.cuts("x", 10, 10)


# ---- 7 ------------------------------------------------------------------------------------------------------------

RECORDS = "record_id long, messages array<struct<role string, content string>>, source string, split string, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def test_overlaps_match_brute_force(spark):
    rng = random.Random(8)
    told = [sentence(rng, rng.randint(3, 60)) for _ in range(80)]

    def record(i, body, split=None):
        return (i, [("system", "told " * 5), ("user", "Question?"), ("assistant", body)], "llm", split, "clash")

    val, train = [record(1000 + i, t, "val") for i, t in enumerate(told)], []
    for i, t in enumerate(told[:60]):
        w = t.split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.2]))):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 99))
        train.append(record(i, " ".join(w).upper()))
    train += [record(100 + i, sentence(rng, 30)) for i in range(60)] + [record(300, told[0]), record(301, told[0])]
    val += [record(2000, told[0], "test"), (2001, None, None, None, None), (2002, [("user", None)], None, "val", None)]
    train += [(400, None, None, None, None), (None, None, None, None, None)]
    text = lambda r: words(" ".join(c or "" for role, c in (r[1] or []) if role != "system"))
    want = set()
    for t in train:
        for v in val:
            a, b = text(t), text(v)
            if a and b and t[0] is not None and lcs(a, b) >= 0.7 * max(len(a), len(b)):
                want.add((min(t[0], v[0]), max(t[0], v[0])))
    make = lambda rows: spark.createDataFrame(rows, RECORDS)
    pairs = split_overlap.overlaps(make(train), make(val), shard=20)
    got = {tuple(r) for r in pairs.collect()}
    assert got == want
    found = split_overlap.matches(make(train), make(val))
    report = split_overlap.report(found, make(train), make(val)).collect()
    assert sum(r.pairs for r in report) == len(want) and sum(r.exact_pairs for r in report) >= 6
    covered = {r.record_id: r for r in split_overlap.coverage(found, make(val)).collect()}
    assert len(covered) == len(val) and covered[2001].coverage == 0 and covered[1000].coverage == 1
    assert sum(r.copies for r in covered.values()) == len(want)
    assert split_overlap.overlaps(make([]), make([])).count() == 0


def edited(rng, body, share):
    """A text with a share of its words, at random places, replaced by others."""
    w = body.split()
    for i in rng.sample(range(len(w)), round(len(w) * share)):
        w[i] = "other" + str(rng.randint(0, 999))
    return " ".join(w)


def overlaps_and_brute_force(spark, train, val):
    make = lambda rows: spark.createDataFrame([(i, [("user", t)], None, None, None) for i, t in rows.items()], RECORDS)
    got = {tuple(r) for r in split_overlap.overlaps(make(train), make(val)).collect()}
    a, b = {i: words(t) for i, t in train.items()}, {i: words(t) for i, t in val.items()}
    return got, {(i, j) for i in a for j in b if lcs(a[i], b[j]) >= 0.7 * max(len(a[i]), len(b[j]))}


def test_overlaps_in_a_hot_group_of_edited_copies(spark):
    rng = random.Random(21)
    base = sentence(rng, 60)
    val = {1000 + i: edited(rng, base, 0.03) for i in range(60)}
    train = {i: edited(rng, base, (0.2, 0.25, 0.3)[i % 3]) for i in range(60)}
    got, want = overlaps_and_brute_force(spark, train, val)
    assert len(want) > 1000 and got == want


def test_overlaps_of_short_records(spark):
    rng = random.Random(22)
    told = {1000 + i: sentence(rng, rng.randint(1, 30)) for i in range(150)}
    train = {i: edited(rng, told[1000 + i], rng.choice((0.1, 0.2, 0.25, 0.3))) for i in range(150)}
    train[500], told[1500] = "four of five agree", "four of five words agree"
    got, want = overlaps_and_brute_force(spark, train, told)
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("shard", [1, 3, 20, 5000])
def test_overlaps_of_templated_records_at_any_shard_size(spark, shard):
    """Records that share a template of 15 words, against a text with two edits: alike with one by 0.9, with the others by 0.7."""
    same = [f"same{i}" for i in range(15)]
    val = {1000 + k: same + [f"own{k}x{i}" for i in range(5)] for k in range(6)}
    text = list(val[1000])
    text[3], text[9] = "edit3", "edit9"  # 13 of the 15 stay
    text[1] = same[1]
    train = {1: text, 2: same[:14] + [f"else{i}" for i in range(6)]}
    make = lambda rows: spark.createDataFrame([(i, [("user", " ".join(t))], None, None, None) for i, t in rows.items()], RECORDS)
    got = {(r.train, r.record_id): r.coverage for r in split_overlap.matches(make(train), make(val), shard=shard).collect()}
    want = {(i, j): lcs(a, b) / max(len(a), len(b)) for i, a in train.items() for j, b in val.items()}
    assert got == {k: v for k, v in want.items() if v >= 0.7} and len(got) == 7


@pytest.mark.parametrize("least", [1, 2, 7, 8, 9, 15, 16])
def test_bits_count_the_shared_words(least):
    rng = np.random.default_rng(least)
    has = rng.random((40, 128)) < 0.4
    has[-1] = False
    which = rng.integers(0, 40, (9, 24))
    found = split_overlap._shared(np.packbits(has, axis=1, bitorder="little").view(np.uint64), which, least)
    assert (np.unpackbits(found.view(np.uint8), axis=1, bitorder="little").astype(bool) == (has[which].sum(1) >= least)).all()


def test_overlap_tasks_read_shards_of_like_length_and_count_words_once(spark, tmp_path, monkeypatch):
    """A task meets only the shards its texts can match, as they were stored: no list, order or hash is made anew for each."""
    rng = random.Random(24)
    texts = {n: [sentence(rng, n) for _ in range(20)] for n in (20, 60)}
    val = [(1000 + n * 100 + i, [("user", t)], None, None, None) for n, told in texts.items() for i, t in enumerate(told)]
    seen = []
    load, order = split_overlap.load_shard, split_overlap.ordered
    monkeypatch.setattr(split_overlap, "load_shard", lambda path, alike: seen.append(path) or load(path, alike))
    monkeypatch.setattr(split_overlap, "ordered", lambda *x: seen.append("order") or order(*x))
    made = {}
    keep = split_overlap._scanner
    monkeypatch.setattr(split_overlap, "_scanner", lambda *x: made.setdefault("args", x) and keep(*x))
    train = spark.createDataFrame([(i, [("user", t)], None, None, None) for i, t in enumerate(texts[20])], RECORDS)
    split_overlap.matches(train, spark.createDataFrame(val, RECORDS), shard=10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts[20])], names=["record_id", "text"])
    found = [p for out in keep(*made["args"])(iter([batch])) for p in out.to_pylist()]
    assert {(p["train"], p["class"]) for p in found} >= {(i, 3000 + i) for i in range(20)}
    near = sum(least <= 20 / 0.7 for _, least, _ in made["args"][0])
    assert seen.count("order") == 1 and len(seen) == 1 + near and near < len(made["args"][0])


def test_overlaps_with_even_edits(spark):
    """Every third word or so changed, so that no run of more than three words is left."""
    rng = random.Random(23)
    told = {1000 + i: sentence(rng, 20 + i % 60) for i in range(60)}
    train = {i: " ".join("new" + str(k) if k % 10 in (2, 5, 9) else w for k, w in enumerate(told[1000 + i].split())) for i in range(60)}
    got, want = overlaps_and_brute_force(spark, train, told)
    assert len(want) >= 40 and got == want


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_leaks_match_brute_force_both_ways(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 40)) for i in range(12)] + [(90, "short item"), (91, None)]
    rows = []
    for i in range(60):
        w = sentence(rng, 50).split()
        source = rng.choice(items[:12])[1].split()
        n = rng.choice([0, 6, 11, 12, 13, 30])
        at = rng.randint(0, 40 - n)
        w[20:20] = source[at : at + n]
        rows.append((i, " ".join(w).upper().replace(" ", rng.choice([" ", ", ", "\n"]))))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    runs = {i: {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)} for i, t in items}
    want = {(d, i) for d, t in rows for i in runs if runs[i] & {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)}}
    tests = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for limit in (leaks.ITEM_WORDS, 1):
        assert {tuple(r) for r in leaks.leaks(docs(spark, rows), tests, limit).collect()} == want
    assert leaks.leaks(docs(spark, rows), tests.limit(0)).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_mixture_reaches_shares_and_caps(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 8 + ["b"]), rng.randint(5, 50)) for i in range(3000)] + [(9000, "other", 10), (9001, "a", 0)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.5, 2), ("none", 0.1, 4), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    total = {s: sum(t for _, x, t in rows if x == s) for s in "ab"}
    mixed = mixture.mix(counts, targets, budget=2 * total["b"])
    got = {r.source: r for r in mixture.shares(mixed, counts, targets.where("source is not null")).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.01 and abs(got["b"].actual_share - 0.5) < 0.01 and got["none"].tokens == 0
    assert {r.n for r in mixed.where("source = 'b'").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} <= {1, 2}
    last = mixed.agg(F.max("place")).first()[0]
    assert 2 * total["b"] <= last < 2 * total["b"] + 50 and mixed.agg(F.sum("tokens")).first()[0] == last
    order = ["place", "doc_id", "copy", "source", "tokens"]
    assert {tuple(r) for r in mixture.mix(counts, targets, budget=2 * total["b"], rows=37).select(order).collect()} == {tuple(r) for r in mixed.select(order).collect()}
    everything = mixture.mix(counts, targets, budget=10**9)
    assert everything.where("source = 'b'").agg(F.sum("tokens")).first()[0] == 2 * total["b"]
    assert mixture.mix(counts.limit(0), targets).count() == 0


def test_ranges_stay_small_with_a_tiny_target(spark):
    """A source with a millionth of the tokens stretches finish times, but no range of rows."""
    rows = [(i, "abc"[i % 3] if i < 30 else "ab"[i % 2], 10 + i % 7) for i in range(4000)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.399999, 1), ("c", 1e-6, 1)], "source string, target_share double, max_repeats int")
    made = mixture.mix(counts, targets, rows=200)
    assert made.agg(F.max("place")).first()[0] == sum(t for _, _, t in rows) and made.count() == 4000


def test_token_counts(spark):
    rows = docs(spark, [(1, "Hello world", "Web "), (2, None, "web"), (3, "x", None), (4, "", "pdf")])
    assert {(r.doc_id, r.source, r.tokens) for r in mixture.token_counts(rows, queries.VOCABULARY).collect()} == {(1, "web", 2), (2, "web", 0), (4, "pdf", 0)}


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(1)
    vocabulary = {s: [f"{s}{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)] for s in ("law", "sport", "energy")}
    rows, labels, truth = [], [], {}
    for i in range(360):
        own = rng.sample(sorted(vocabulary), rng.choice([1, 1, 2]))
        told = [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(vocabulary[rng.choice(own)]) for _ in range(80)]
        rows.append((i, " ".join(told)))
        truth[i] = set(own)
        if i % 3 == 0:
            labels += [(i, s, "r") for s in own] + ([(i, rng.choice(sorted(vocabulary)), "bad")] if i % 30 == 0 else []) + ([(i, None, "r"), (i, "unknown", "r")] if i % 9 == 0 else [])
    rows += [(900, None), (901, ""), (902, "nothing known here")]
    subjects = spark.createDataFrame([("law", "x"), ("sport", None), ("energy", "y")], "subject string, covers string")
    raters = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    found = defaultdict(set)
    for r in subject_areas.subjects_of(docs(spark, rows), raters, subjects).collect():
        found[r.doc_id].add(r.subject)
    held = [i for i in truth if i % 3]
    assert sum(found[i] == truth[i] for i in held) > 0.9 * len(held)
    assert not found[900] and not found[901] and not found[902]
    assert subject_areas.subjects_of(docs(spark, []), raters.limit(0), subjects).count() == 0


def test_subjects_are_learned_from_all_documents(spark):
    """Words that only unrated documents have, beyond more than 4,000 rated ones, are known by the documents in which they meet others."""
    rng = random.Random(3)
    letters = [chr(97 + i) + chr(97 + j) for i in range(5) for j in range(5)]
    vocabulary = {s: [s + x for x in letters] for s in ("law", "sport", "novel")}
    told = lambda *own: " ".join(rng.choice(vocabulary[rng.choice(own)]) for _ in range(12))
    rows = [(i, told(("law", "sport")[i % 2])) for i in range(4100)]
    rows += [(5000 + i, told("sport", "novel")) for i in range(200)] + [(6000 + i, told("novel")) for i in range(100)]
    raters = spark.createDataFrame([(i, ("law", "sport")[i % 2], "r") for i in range(4100)], "doc_id long, subject string, rater string")
    subjects = spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, covers string")
    found = defaultdict(set)
    for r in subject_areas.subjects_of(docs(spark, rows), raters, subjects).collect():
        found[r.doc_id].add(r.subject)
    assert all(found[i] == {("law", "sport")[i % 2]} for i in range(4100))
    assert all(found[i] == {"sport"} for i in range(6000, 6100))
    words = subject_areas.counts(docs(spark, rows), subject_areas.label_sets(raters, ["law", "sport"]).select("doc_id", F.lit(None).cast("array<int>").alias("subjects")), None)
    terms, frequency, n = subject_areas.vocabulary(words)
    assert n == len(rows) and len(terms) == 75 and frequency.sum() == sum(len(set(t.split())) for _, t in rows)


def test_bisecting_separates_clusters():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(4), 20, axis=0) + rng.normal(0, 0.05, (80, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = subject_areas.bisect(x, leaves=4, smallest=5)
    assert len({tuple(leaf[i * 20 : i * 20 + 20]) for i in range(4)}) == 4 and all(len(set(leaf[i * 20 : i * 20 + 20])) == 1 for i in range(4))


# ---- queries ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p1_statistics", "p6_found", "p8_found", "p9_shares"])
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_tables_without_rows_and_with_nulls(spark, bare_tables, name):
    empty, nulls = bare_tables
    rows = queries.QUERIES[name](spark, empty).collect()
    assert not rows or "shares" in name
    queries.QUERIES[name](spark, nulls).collect()
