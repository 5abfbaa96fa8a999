import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import near_copies, packing
from skeinflow.llm.components import components
from skeinflow.llm.leaks import Index, leaks, words_of
from skeinflow.llm.lookalike_pairs import look_classes, same_look_members, same_look_pairs
from skeinflow.llm.lookalikes import canonical, look_key


def form(text):
    return canonical(text)[0]


@pytest.mark.parametrize(
    "a, b",
    [("abc", "аbс"), ("naïve", "nai\u0308ve"), ("a\u200bb\u00adc", "abc"), ("a b", "a\u00a0b"), ("a b", "a\u2009b"), ("Ａ１％", "A1%"), ("ﬁx oﬀ", "fix off"), ("a‑b", "a-b"), ("TOP", "ΤΟΡ"), ("рот", "pот"), ("Йод", "И\u0306од"), ("ガ", "カ\u3099"), ("ガ", "ｶﾞ"), ("a\r\nb", "a\nb"), ("сор", "cop"), ("жук а дом", "жук a дом"), ("ё", "ë"), ("\ufeffx", "x")],
)
def test_same_look(a, b):
    assert form(a) == form(b) and look_key(a) == look_key(b)


@pytest.mark.parametrize("a, b", [("abc", "Abc"), ("e", "é"), ("x2", "x²"), ("1", "①"), ("ж", "x"), ("a  b", "a b"), ("“a”", '"a"'), ("。", "."), ("o", "0"), ("b", "в")])
def test_other_look(a, b):
    assert form(a) != form(b)


def test_scripts_and_counts():
    assert canonical("mixеd token") == ("mixed token", 1, 0)
    assert form("слово оно") == "слово оно" and form("pocт") == "рост"
    assert canonical("\u200b")[0] == "" == form("")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_the_form_is_stable(text):
    once = form(text)
    assert form(once) == once and unicodedata.is_normalized("NFC", once)


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = ["ok", "see above", "naïve", "рост и рот", "ab fi", ""]

    def vary(t):
        return "".join(rng.choice([c, c, c, {"o": "о", "a": "а", "e": "е", " ": "\u00a0", "i": "і"}.get(c, c), c + "\u200b"]) for c in t)

    docs = [(i, rng.choice([None, *[vary(t) for t in base]])) for i in range(120)]
    got = {(r.doc_a, r.doc_b) for r in same_look_pairs(look_classes(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    want = {(i, j) for i, a in docs for j, b in docs if i < j and a and b and a != b and form(a) == form(b)}
    assert got == want and want
    frame = look_classes(spark.createDataFrame(docs + docs[:9], "doc_id long, text string"))
    assert {(r.doc_a, r.doc_b) for r in same_look_pairs(frame, per_part=3).collect()} == want
    links = {r.doc_id: r.n_links for r in same_look_members(look_classes(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert links == {i: sum(i in pair for pair in want) for i, t in docs if t}
    none = look_classes(spark.createDataFrame([], "doc_id long, text string"))
    assert same_look_pairs(none).count() == 0 and same_look_members(none).count() == 0


WORDS = "amber bold brisk calm cobalt dapper dusty eager early faint frosty gentle grand hazel humble inner ivory jolly junior keen lucid lunar mellow minor nimble noble opal outer plain proud quiet rapid rustic silver stern tidy umber vivid witty young zesty".split()


def test_leaks(spark):
    rng = random.Random(8)

    def sentence(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    shared = "answer with exactly one of the listed options and give no explanation"
    items = [(i, sentence(30) + ". " + shared) for i in range(12)] + [(98, "too short"), (99, None)]
    text = {i: t for i, t in items if t}
    own = {i: text[i].split(". ")[0].split() for i in range(12)}
    docs = {
        1: sentence(200) + " " + text[0] + " " + sentence(50),
        2: sentence(40) + "\n\n" + " ".join(own[1][:18]).upper().replace(" ", "\n- ") + "\n" + sentence(40),
        3: sentence(40) + " ".join(own[2][20:] + own[2][:12]) + " x",
        4: " ".join(w if k % 9 else "changed" for k, w in enumerate(own[3])),
        5: sentence(60) + " " + shared,
        6: " ".join(own[4][:9]) + " " + sentence(60),
        7: " ".join(own[5]).replace("a", "а").replace("o", "о\u200b"),
        8: "", 9: None, 10: "word", 11: text[6] + " " + text[7],
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, q).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (7, 5), (11, 6), (11, 7)}
    assert {(r.doc_id, r.item_id) for r in leaks(d, q, block=60).collect()} == got
    assert leaks(d, q.limit(0)).count() == 0 and leaks(d.limit(0), q).count() == 0


def test_close_edits_are_found_while_five_words_stand(spark):
    words = [f"{w}{k}" for k, w in enumerate(WORDS)]
    edited = [w if k % 6 else f"changed{k}" for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(words[:5] + ["x"] * 40)), (3, " ".join(w if k % 5 else "x" for k, w in enumerate(words)))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(d, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()] == [(1, 7)]


def test_items_of_many_suites_keep_their_shingles(spark):
    text = " ".join(f"{w}{k}" for k, w in enumerate(WORDS))
    other = " ".join(f"{w}{k + 50}" for k, w in enumerate(WORDS))
    # Equal words in five spellings, a near copy, and a text that only shares the last sentence with all of them.
    same = [text, text.upper(), text.replace(" ", "\n"), text + "!", text.replace("a", "а")]
    near = text.replace("minor18", "minus18") if "minor18" in text else text.replace(text.split()[18], "minus18")
    items = [*enumerate(same), (5, near), (6, other + " " + " ".join(text.split()[-8:])), (7, text), (7, text)]
    d = spark.createDataFrame([(1, "before " + text + " behind"), (2, other), (2, other), (3, " ".join(text.split()[-8:]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 7), (2, 6)]


def test_every_text_of_an_item_counts(spark):
    texts = [" ".join(f"{w}{k + shift}" for k, w in enumerate(WORDS)) for shift in (0, 50, 100, 150, 200)]
    # What the texts of one item share stays its own.
    tail = " ".join(f"tail{k}" for k in range(60))
    items = [(7, t + " " + tail) for t in texts[:3]] + [(7, texts[0] + " " + tail), (8, texts[1]), (9, texts[3]), (9, texts[4])]
    docs = [*enumerate(texts), (5, tail), (6, texts[0] + " " + tail), (7, texts[1] + " " + tail)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 8), (3, 9), (4, 9), (5, 7), (6, 7), (7, 7), (7, 8)]


def test_order_of_shingles_comes_from_all_items(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Index, "__init__", lambda self, rows, share, make=Index.__init__: seen.append(rows) or make(self, rows, share))
    texts = [" ".join(f"{w}{k + shift}" for k, w in enumerate(WORDS)) for shift in (0, 50)]
    items = [(1, texts[0]), (2, texts[1] + " " + " ".join(texts[0].split()[-9:]))]
    d = spark.createDataFrame([(k, f"{texts[0]} {k}") for k in range(300)], "doc_id long, text string")
    got = leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, 1) for k in range(300)}
    both = seen[0].groupby("code").size()
    assert (seen[0]["frequency"] == seen[0]["code"].map(both) - 1).all() and (both == 2).sum() == 5


def _brute_share(item, own, words):
    known = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    places = {q for p in own for q in range(p, p + 5)}
    return len({q for p in own if tuple(item[p : p + 5]) in known for q in range(p, p + 5)}) / len(places)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_prefixes_and_bounds_lose_no_case(seed, share):
    rng = random.Random(seed)
    items = [[rng.choice(WORDS[:12]) for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    own = [sorted(rng.sample(range(len(w) - 4), rng.randrange(1, len(w) - 3))) for w in items]
    frequency = {}
    rows = [(str(i), int(packing.shingles(w)[p]), p, len(w), frequency.setdefault(int(packing.shingles(w)[p]), rng.choice([0, 0, 1, 5, 90]))) for i, w in enumerate(items) for p in own[i]]
    index = Index(pd.DataFrame(rows, columns=["rep", "code", "pos", "n_words", "frequency"]), share)
    for _ in range(15):
        words = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(items)
            a = rng.randrange(len(w))
            words += w[a : a + rng.randrange(1, 40)] + [rng.choice(WORDS)] * rng.randrange(3)
        want = {str(i): round(_brute_share(w, own[i], words), 9) for i, w in enumerate(items) if _brute_share(w, own[i], words) >= share - 1e-9}
        found = index.cases(words)
        assert {r: round(s, 9) for r, s, _ in found} == want and all(best <= s + 1e-9 for _, s, best in found)


def test_words():
    assert words_of("Ａ_b—Ｃ\u200bd _x_ __") == ["a_b", "cd", "x"] and words_of(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 90), st.integers(1, 6))
def test_best_fit(sizes, capacity, sources):
    source = [i % sources for i in range(len(sizes))]
    at = packing.best_fit(sizes, source, list(range(len(sizes))), capacity)
    used = {}
    for i, k in enumerate(at):
        used[k] = used.get(k, 0) + sizes[i]
    assert all(v <= capacity for v in used.values()) and sorted(used) == list(range(len(used)))
    assert at == packing.best_fit(sizes, source, list(range(len(sizes))), capacity)


def test_duplicates_do_not_share_containers():
    at = packing.best_fit([10] * 400, list(range(400)), [0, 0, 0] + list(range(1, 398)), 100)
    assert len({at[0], at[1], at[2]}) == 3


def test_sources_and_clusters_stay_apart_wherever_they_can():
    # 40 containers of ten: a source of 30 and a cluster of 35 fit one to each; a source of 60 has to meet itself.
    for n in (30, 40):
        at = packing.best_fit([10] * 400, [0] * n + list(range(1, 401 - n)), list(range(400)), 100)
        assert len(set(at[:n])) == n and max(at) < 42
    at = packing.best_fit([10] * 400, list(range(400)), [0] * 35 + list(range(1, 366)), 100)
    assert len(set(at[:35])) == 35
    at = packing.best_fit([10] * 400, [0] * 60 + list(range(1, 341)), list(range(400)), 100)
    assert max(at[:60].count(k) for k in set(at)) == 2 and max(at) < 42
    at = packing.best_fit([10] * 400, [0] * 60 + list(range(1, 341)), list(range(400)), 100, strict=True)
    assert len(set(at[:60])) == 60
    # Small pieces of a large source find room without it.
    sizes = [100] * 20 + [60, 30] * 20 + [10] * 20
    at = packing.best_fit(sizes, list(range(60)) + [99] * 20, list(range(80)), 100)
    assert len(set(at[60:])) == 20 and max(at) == 39


def test_near_copies_do_not_share_containers(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
        texts += [" ".join(words), " ".join(words), " ".join(words[:30] + ["other"] + words[31:]).upper(), " ".join(words[:30] + ["more", "other"] + words[31:50] + ["end"]), " ".join(words[3:])]
    texts += [" ".join(f"{w} boilerplate of every single text" for w in WORDS[k : k + 20]) for k in range(6)] + ["one two", "one two", "one three"]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sets = [set(packing.shingles(words_of(t)).tolist()) for t in texts]
    alike = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if words_of(texts[i]) == words_of(texts[j]) or (a and b and len(a & b) >= 0.8 * len(a | b))}
    assert any(words_of(texts[i]) != words_of(texts[j]) for i, j in alike)
    budget = spark.createDataFrame([(1, "a", 1500)], "budget_id int, label string, capacity long")
    at = {r.doc_id: r.container for r in packing.pack(docs, budget).collect()}
    assert len(at) == len(texts) and all(at[i] != at[j] for i, j in alike)

    # The clusters are the components of all pairs, whichever shingles are taken for frequent.
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    for frequent in (near_copies.frequent_codes(docs, one_of=1), near_copies.frequent_codes(docs, one_of=1, least=10**6)):
        marks = []
        for i, t in enumerate(texts):
            codes = near_copies.np.unique(packing.shingles(words_of(t)))
            marks.append((i, near_copies.word_cluster(words_of(t)), len(codes), near_copies.prefix_of(codes, *frequent, 0.8)))
        for hot in (1000, 2):  # with and without shingles that too many texts have
            near = {r.cluster: r.near for r in near_copies.near_clusters(spark.createDataFrame(marks, "doc_id long, cluster long, n_codes int, prefix array<long>"), docs, 0.8, hot).collect()}
            got = [near.get(m[1], m[1]) for m in marks]
            assert all((got[i] == got[j]) == (root[i] == root[j]) for j in range(len(texts)) for i in range(j))


def test_long_chains_are_one_component(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.cluster: r.near for r in components(pairs).collect()} == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_packing_is_whole(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["Grüße 世界 ", "plain words here ", "x"]) * rng.choice([1, 5, 40, 300]), f"s{i % 3}") for i in range(80)] + [(100, "", "s"), (101, None, "s"), (102, "tail", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    b = spark.createDataFrame([(1, "a", 64), (2, "b", 300), (None, "n", 5)], "budget_id int, label string, capacity long")
    texts = {i: t for i, t, _ in docs if t}
    packed = packing.pack(d, b, block_items=50).collect()
    encoding = packing.tokenizer()
    for budget, capacity in ((1, 64), (2, 300)):
        own = [r for r in packed if r.budget_id == budget]
        used = {}
        pieces = {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens))
        assert max(used.values()) <= capacity and sorted(used) == list(range(1, len(used) + 1)) and set(pieces) == set(texts)
        for i, parts in pieces.items():
            parts.sort()
            assert "".join(texts[i][a:z] for a, z, _ in parts) == texts[i]
            total = len(encoding.encode_ordinary(texts[i]))
            assert sum(n for _, _, n in parts) == total and (len(parts) == 1) == (total <= capacity)
    room = {r.budget_id: r.used for r in packing.room_left(packing.pack(d, b), b, d).collect()}
    assert room[1] > 0.9
    assert packing.pack(d.limit(0), b).count() == 0 and packing.pack(d, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, spark.createDataFrame([(1, "a", 3)], "budget_id int, label string, capacity long"))
