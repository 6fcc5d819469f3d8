"""The training-data operators against brute force and hand-made cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import idmap, mixing, packing, pii, pii_lexer, queries, setjoin, tokens, topn


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_pigeonhole_join_is_exact(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    refs = [word(rng.randint(4, 9)) for _ in range(60)]
    ins = [word(rng.randint(1, 11)) for _ in range(150)] + refs[:5]
    for k in (0, 1, 2):
        i = spark.createDataFrame([(x, "1", x) for x in sorted(set(ins))], "value string, strict string, letters string")
        r = spark.createDataFrame([(x, "1", x, min(k, len(x) % 3)) for x in sorted(set(refs))], "ref string, strict string, letters string, allowed int")
        got = {(a, b, d) for a, b, d in idmap.pigeonhole_join(i, r, k).collect()}
        assert got == {(a, b, lev(a, b)) for a in set(ins) for b in set(refs) if lev(a, b) <= min(k, len(b) % 3)}


def test_a_plain_list_needs_no_numbers_or_class_words(spark):
    refs = spark.createDataFrame([("Berlin",), ("Hamburg",), ("software engineer",), ("Coca Cola",), ("ab kinase 4",), ("Ulm",), ("Au",), ("Łódź",), ("7157",), ("---",)], "name string")
    typed = {"Berlin": "Berlin", "Berln": "Berlin", "Software Enginer": "software engineer", "coca-cola": "Coca Cola", "ab kinase 4": "ab kinase 4", "hamburg": "Hamburg", "Engineer, Software": "software engineer",
             "ulm": "Ulm", "Uln": "Ulm", "au": "Au", "ab": None, "7157": "7157", "7158": None, "---": "---", "Bremen": None, "ab kinase 5": None, "łódź": "Łódź"}
    matched, unmatched = idmap.map_values(spark.createDataFrame(list(enumerate(typed)), "id int, text string"), "text", refs, "name")
    assert {r.text: r.ref for r in matched.collect()} == {t: r for t, r in typed.items() if r}
    assert {(r.text, r.why) for r in unmatched.collect()} == {(t, "no entry") for t, r in typed.items() if not r}
    twins = spark.createDataFrame([("marbach",), ("marbech",)], "name string")
    assert [r.why for r in idmap.map_values(spark.createDataFrame([("marbich",)], "text string"), "text", twins, "name")[1].collect()] == ["tie"]


def test_recall_on_an_unseen_list(spark):
    """Job titles with class words, typed with slips and short forms, against brute force over edits."""
    rng = random.Random(8)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(3, 5))) for _ in range(60)]
    refs = sorted({f"{s} {c} {rng.randint(1, 5)}" for s in stems for c in rng.sample(["manager", "engineer", "assistant", "director"], 2)})
    short = {"manager": "mgr.", "engineer": "eng", "assistant": "asst", "director": "dir."}
    typed, want = [], {}
    for i in range(400):
        ref = rng.choice(refs)
        stem, role, n = ref.split()
        at = rng.randrange(len(stem))
        slip = rng.choice([stem, stem[:at] + rng.choice("xz") + stem[at:], stem[:at] + stem[at + 1 :], stem.upper()])
        text = rng.choice([f"{slip} {role} {n}", f"{slip}-{short[role]}-{n}", f"{role.title()} {n}, {slip}"])
        typed.append((i, text))
        want[i] = ref
    matched, _ = idmap.map_values(spark.createDataFrame(typed, "id int, text string"), "text", spark.createDataFrame([(r,) for r in refs], "name string"), "name")
    got = {r.id: r.ref for r in matched.collect()}
    right = sum(got.get(i) == r for i, r in want.items())
    assert right / len(want) >= 0.9 and right / len(got) >= 0.97


def test_map_values(spark):
    # enough names for the class words of the list to be learned from it
    stems = ["brokafen", "delmuniq", "fostarip", "gurlanda", "hestimor", "jaklopus"]
    more = [(f"{s} {c} {i}",) for i, s in enumerate(stems, 1) for c in ("kinase", "ligase", "receptor beta", "nuclear receptor")]
    refs = spark.createDataFrame([("zaltomir kinase 4",), ("zaltomir ligase 4",), ("nuclear zaltomir receptor beta 2",), ("ABCD12A",), ("XZ_1234567",), (None,), *more], "name string")
    typed = {
        "Zaltomir-Kinase-IV": "zaltomir kinase 4", "kinase four, zaltmoir": "zaltomir kinase 4", "zaltomir kin. (4) [mouse]": "zaltomir kinase 4", "za1tomir ligase4": "zaltomir ligase 4",
        "nucl. zaltomir rec. β 2, putative": "nuclear zaltomir receptor beta 2", "sym:abcd-12a": "ABCD12A", "ABCD12A (human)": "ABCD12A", "ref|xz 1234567.3|x": "XZ_1234567",
        "zaltomir kinase 5": None, "zaltomir receptor beta 2": None, "nuclear zaltomir receptor alpha 2": None, "ABCD13A": None, "XZ_1234568": None, "unknown": None, "": None, " ": None, "x" * 5000: None, "kinase": None, "7": None,
    }
    data = [(i, t, "clash") for i, t in enumerate([*typed, None, *list(typed)[:1]])]
    matched, unmatched = idmap.map_values(spark.createDataFrame(data, "id int, text string, code string").withColumn("ref", F.lit(1)).withColumn("words", F.lit(2)).withColumn("why", F.lit(3)), "text", refs, "name", labels=queries.LABELS, added=queries.ADDED)
    got = {r.id: r.ref for r in matched.collect()}
    assert got == {i: typed[t] for i, t, _ in data if t in typed and typed[t]}
    assert {r.id for r in unmatched.collect()} == {i for i, _, _ in data} - set(got)
    assert idmap.map_values(spark.createDataFrame([], "id int, text string"), "text", refs, "name")[0].count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_similar_sets(spark, seed):
    rng = random.Random(seed)
    sets = {}
    for c in range(12):
        base = rng.sample(range(200), rng.randint(3, 14))
        for m in range(rng.randint(1, 6)):
            s = set(base)
            for _ in range(rng.randint(0, 3)):
                s.discard(rng.choice(base)) if rng.random() < 0.5 else s.add(rng.randrange(200))
            sets[f"s{c}_{m}"] = s | {999} if rng.random() < 0.5 else s
    sets |= {"empty": set(), "one": {5}, "uno": {5}}
    rows = [(k, [*v, *list(v)[:1], None] if v else []) for k, v in sets.items()] + [("null", None)]
    classes, members = setjoin.set_classes(spark.createDataFrame(rows, "id string, items array<bigint>"))
    pairs = setjoin.similar_classes(classes)
    got = {tuple(r) for r in setjoin.expand(pairs, members).collect()}
    want = {(a, b) for a, b in combinations(sorted(k for k, v in sets.items() if v), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got == want
    links = {r.id: r.n_links for r in setjoin.link_counts(pairs, members).collect()}
    count = Counter(x for p in want for x in p)
    assert links == {k: count[k] for k, v in sets.items() if v}


def test_top_n(spark):
    rng = random.Random(2)
    data = [(rng.choice(["big", "big", "big", "a", None]), rng.choice([1, None, 1, 1]), f"i{rng.randrange(60)}", rng.choice([None, float("nan"), -1.0, -2.0, -3.0]), rng.choice([None, 1.0, 2.0])) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, c int, item string, score double, second double").withColumn("salt", F.lit(1))
    best = defaultdict(dict)
    for g, c, i, s, e in data:
        if g is not None and c is not None and s is not None and s == s:
            key = (s, e is None, -(e or 0), i)
            best[g, c][i] = min(best[g, c].get(i, key), key)
    want = {(g, c, k[3], r) for (g, c), d in best.items() for r, k in enumerate(sorted(d.values())[:3], 1)}
    for rows in (20, 10**6):
        assert {(r.g, r.c, r["item"], r["rank"]) for r in topn.top_n(df, ["g", "c"], "item", "score", "second", 3, subgroup_rows=rows).collect()} == want
    assert topn.top_n(df.limit(0), ["g", "c"], "item", "score", "second").count() == 0


def test_top_n_splits_any_number_of_large_groups(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("g"), F.concat(F.lit("i"), (F.col("id") % 17 * 3001 + F.col("id")).cast("string")).alias("item"), (F.hash("id") % 50).cast("double").alias("score"))
    want = defaultdict(list)
    for g, i, v in df.collect():
        want[g].append((v, i))
    got = defaultdict(list)
    for r in topn.top_n(df, ["g"], "item", "score", n=2, subgroup_rows=4).collect():
        got[r.g].append((r.score, r["item"]))
    assert len(want) == 3000 and {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:2] for g, v in want.items()}


def test_best_boundaries():
    rng = np.random.default_rng(3)
    counts = np.zeros(13, int)
    counts[1:] = rng.integers(0, 5, 12)
    sizes = [s for s in range(13) if counts[s]]
    pad = lambda ends: sum(counts[s] * (min(e for e in ends if e >= s) - s) for s in sizes)
    best = min(pad([*c, sizes[-1]]) for c in combinations(sizes[:-1], 2))
    assert pad(packing.best_boundaries(counts, 3)) == best
    assert packing.best_boundaries(np.zeros(5, int), 3) == []


def test_pack(spark):
    rng = random.Random(4)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(300)] + [0, None, 100, 205, 1000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n int").withColumn("bucket", F.lit(1))
    got = packing.pack(df, ["doc_id"], "n", 100, buckets=4).collect()
    load, by = Counter(), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        if r.container is not None:
            load[r.container] += r.n_tokens
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    for i, s in enumerate(sizes):
        assert sum(r.n_tokens for r in by[i]) == (s or 0) and len(by[i]) == max(1, -(-(s or 0) // 100))
        assert (by[i][0].container is None) == (not s)
    # few buckets pad a lot; the default number does not
    report = packing.fill_report(packing.pack(df, ["doc_id"], "n", 100), 100).first()
    assert report.overfull == 0 and report.n_tokens == sum(s or 0 for s in sizes) and report.unused_share < 0.02
    assert packing.pack(df.limit(0), ["doc_id"], "n", 100).count() == 0


def test_largest_total():
    rng = random.Random(5)
    for _ in range(100):
        w = [rng.random() + 0.01 for _ in range(rng.randint(1, 6))]
        parts = [(x / sum(w), rng.random() * 10 + 0.1) for x in w]
        for allowed in (0.0, 0.02, 0.3):
            t = mixing.largest_total(parts, allowed)
            miss = lambda t: sum(max(0.0, a * t - c) for a, c in parts) - allowed * t  # noqa: B023, E731
            assert miss(t) <= 1e-9 and miss(t * 1.01) > 0


def test_a_scarce_source_has_its_share_by_default(spark):
    docs = [(i, "big", 100) for i in range(1000)] + [(2000 + i, "scarce", 100) for i in range(5)]
    targets = spark.createDataFrame([("big", 0.99, 1), ("scarce", 0.01, 1)], "source string, target_weight double, max_repeat int")
    shares = {r.source: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int"), targets, block_tokens=100)[1].collect()}
    total = sum(r.selected_tokens for r in shares.values())
    # exact to one slot of the schedule, 100 tokens of about 50,000
    assert abs(shares["scarce"].selected_tokens - 0.01 * total) <= 100 and shares["scarce"].actual_share > 0.0075


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice([" Big", "big ", "BIG", "big", "mid", "small", "other", None]), rng.randint(0, 60)) for i in range(6000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_weight double, max_repeat int")
    sel, shares = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int"), targets, block_tokens=128, max_shortfall=0.0)
    rows = sel.collect()
    used = Counter(r.doc_id for r in rows)
    cap = {"big": 1, "mid": 2, "small": 4}
    assert all(used[r.doc_id] <= cap[r.source] for r in rows) and len({(r.doc_id, r.repetition) for r in rows}) == len(rows)
    total = sum(r.n_tokens for r in rows)
    for r in shares.collect():
        assert r.actual_share == pytest.approx({"absent": 0, "big": 0.5, "mid": 0.3, "small": 0.15}[r.source] / 0.95, abs=0.01)
        assert r.max_used <= r.max_repeat
    # every stretch of the schedule has nearly the target shares
    top = max(r.slot for r in rows)
    half = Counter()
    for r in rows:
        half[r.source] += r.n_tokens if r.slot < top / 2 else 0
    assert half["big"] / sum(half.values()) == pytest.approx(0.5 / 0.95, abs=0.03) and total > 0
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, n_tokens int"), targets)[1].count() == 4


def test_token_count(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 20000,)], "t string")
    got = [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 100


GIVEN = "Emily John Wei Priya Sarah Ahmed Laura Tom Michael Jessica Fatou Sven Olga Raj Linda Kevin Isabel Takeshi Pierre Camille".split()
FAMILY = "Carter Smith Zhang Patel Khan Müller Baker Johnson Williams Nguyen Diallo Larsson Petrova Gupta Murphy Tanaka Lindgren Kowalska Dupont Moreau".split()
HELD_GIVEN = "Noor Ewan Siobhan Marta Diego Björn Yan Agnieszka".split()
HELD_FAMILY = "Haddad McDonald Byrne Silva Fernández Garland Liu Ostrowski".split()


def _texts(n, seed, given, family):
    """Letters with known personal information; sentences and names are this test's own."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g, f = rng.choice(given), rng.choice(family)
        name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {rng.choice('ABC')}. {f}"])
        mail, phone = f"{g.lower()}{rng.randint(1, 99)}@lab.example.org", f"+44 20 7946 0{rng.randint(100, 999)}"
        ident, street = f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", f"{rng.randint(1, 400)} {rng.choice(['Urlach', 'Milford', 'Harbour', 'Station'])} {rng.choice(['Road', 'Street', 'Lane'])}"
        person = rng.choice(["The list was sent by {}.", "Please ask Dr. {} about it.", "Patient {} was seen on Monday.", "Thanks to {} for the plates.", "Contact: {}", "Regards,\n{}\n"])
        parts = [(person.format(name), (name, "person_name")), (f"Write to {mail} for the rows.", (mail, "email")), (f"Call {phone} before noon.", (phone, "phone")), (f"Passport {ident} was copied.", (ident, "identity_number")), (f"The samples moved to {street}.", (street, "street_address")),
                 (f"The method of {rng.choice(family)} et al. was followed.", None), (f"Lot 55-1234-77 of the kit gave net@edges {rng.randint(10, 99)} rows.", None), ("Genes were ranked by score in Ostgaard medium.", None), (f"Panel {rng.randint(1, 9)} of the figure shows {rng.randint(100, 9999)} genes.", None)]
        rng.shuffle(parts)
        out.append((" ".join(p for p, _ in parts), {x for _, x in parts if x}))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.fit([t for t, _ in _texts(700, 1, GIVEN, FAMILY)])


def test_names_are_learned_from_their_contexts():
    names = pii_lexer.learn_names([t for t, _ in _texts(700, 1, GIVEN, [x + "sson" for x in ("Erik", "Karl", "Lars", "Nils", "Olof", "Bengt", "Arne", "Sten")])])
    assert len(names.given & {g.lower() for g in GIVEN}) >= 18 and "sson" in names.endings and not names.given & {"panel", "regards", "contact", "lot"}


def test_personal_information_with_unseen_names(spark, field):
    held = _texts(120, 2, HELD_GIVEN, HELD_FAMILY)
    docs = [(i, t) for i, (t, _) in enumerate(held)] + [(1000, None), (1001, ""), (1002, held[0][0] + " " + held[1][0] * 40), (1003, "no one here")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("start", F.lit(1))
    found, by_id = defaultdict(set), dict(docs)
    for r in pii.find(df, field).collect():
        assert by_id[r.doc_id][r.start : r.end] == r.pii_text
        found[r.doc_id].add((r.pii_text, r.pii_kind))
    for kind in pii_lexer.KINDS[1:]:
        want = {(i, x) for i, (_, w) in enumerate(held) for x in w if x[1] == kind}
        got = {(i, x) for i in range(len(held)) for x in found[i] if x[1] == kind}
        assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got), (kind, len(want), len(got), len(want & got), list(want - got)[:5], list(got - want)[:5])
    assert found[1002] and not any(found[i] for i in (1000, 1001, 1003))
    text = {r.doc_id: (r.text, r.n_replaced) for r in pii.redact(df, field).collect()}
    assert text[1000] == (None, 0) and text[1001] == ("", 0) and text[1003] == ("no one here", 0)
    assert "[EMAIL]" in text[0][0] and "Lot 55-1234-77" in text[0][0] and not any(s in text[0][0] for s, _ in found[0] if "@" in s)
    assert pii.find(df.limit(0), field).count() == 0


def test_skip_edges_carry_evidence():
    """A weak mention follows a sure one of the same document, however far apart."""
    zero = np.zeros((pii.LABELS, pii.LABELS))
    field = pii.Field(np.zeros((pii.DIM, pii.LABELS), np.float32), np.zeros(pii.LABELS, np.float32), zero, zero.copy())
    field.skip[9, 9] = 2.0
    batch = pii.read(["Skorvik wrote. " + "Then more text came. " * 30 + "Later Skorvik left.", "Skorvik"], pii.Codes())
    at = [i for i, (a, b) in enumerate(zip(batch.start, batch.end, strict=True)) if b - a == 7]
    assert [at[0], at[1]] in batch.skip.tolist() and all(batch.doc[a] == batch.doc[b] for a, b in batch.skip)
    score = np.zeros((len(batch.doc), pii.LABELS), np.float32)
    score[:, 0] = 1.0
    score[at[0], 9] = 6.0
    out = pii.beliefs(field, batch, score)
    assert out[at[1], 9] - out[at[1], 0] > score[at[1], 9] - score[at[1], 0]
    assert out[at[2], 9] - out[at[2], 0] == pytest.approx(-1.0, abs=1e-4)


def test_node_potentials_of_a_batch_equal_their_features():
    """What is added up per distinct text is the sum over each node's own features."""
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.DIM, pii.LABELS)).astype(np.float32), rng.normal(size=pii.LABELS).astype(np.float32), np.zeros((pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    codes = pii.Codes()
    batch = pii.read([t for t, _ in _texts(3, 4, GIVEN, FAMILY)] + ["a", "", "é 🙂 12-34"], codes)
    index = pii.feature_index(batch, codes, np.arange(len(batch.doc)))
    assert np.allclose(pii.unary(field, batch, codes), field.bias + field.weights[index].sum(1), atol=1e-3)


def test_tokens_cover_the_text():
    text = "Dr. Nora A. Skorvik, 12 bis, avenue Larkfen; (020) 7946-0111 nora [at] lab [dot] example é 🙂 a_b"
    assert "".join(m.group() for m in pii_lexer.TOKEN.finditer(text)) == text.replace(" ", "")
