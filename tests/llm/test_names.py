import pytest

from diffloom.llm import names as m


@pytest.mark.parametrize(
    ("typed", "kind", "words"),
    [
        ("Agnes Kilanikil", "full", ["agnes", "kilanikil"]), (" Agnes  H. KILANIKIL ", "full", ["agnes", "kilanikil"]), ("Kilanikil, Agnes H.", "full", ["agnes", "kilanikil"]), ("A. Kilanikil", "short", ["a", "kilanikil"]),
        ("Kilanikil A", "short", ["a", "kilanikil"]), ("agnes.kilanikil", "full", ["agnes", "kilanikil"]), ("agneskilanikil", "handle", ["agneskilanikil"]), ("Agnes Kilanikil <a@b.example>", "full", ["agnes", "kilanikil"]),
        ("Agnes Kilanikil (away)", "full", ["agnes", "kilanikil"]), ("Agnes Kilanikil - QA", "full", ["agnes", "kilanikil"]), ("Agnes Kilanikil @ laptop", "full", ["agnes", "kilanikil"]), ("Hönivasa, U.", "short", ["u", "honivasa"]),
        ("The Rutidoler Found. & Co", "org", ["foundation", "rutidoler"]), ("Systems Dribabimar, Ltd", "org", ["dribabimar", "systems"]), ("(no author)", "nobody", []), ("Unknown", "nobody", []), ("", "nobody", []), (None, "nobody", []), ("???", "nobody", []),
        ("<jo.smith@mail.example>", "full", ["jo", "smith"]),
    ],
)
def test_parse(typed, kind, words):
    got = m.parse(typed)
    assert got[:2] == (kind, words)


def test_collision_curve():
    b = m.bands_for()
    assert 1 - (1 - m.SIMILAR**m.ROWS) ** b >= m.RECALL
    assert 1 - (1 - m.SIMILAR**m.ROWS) ** (b - 1) < m.RECALL


def entities(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "author string")
    return {r.author: r.entity for r in m.link_names(rows).collect()}


def test_variants_link_and_others_do_not(spark):
    names = [
        "Gabriel Menamemol", "Gabriel Menamemol", "Gabe Menamemol", "Menamemol, Gabriel C.", "Gabriel Menameoml", "gabrielmenamemol", "gmenamemol", "G. Menamrmol", "Robert Menamemol", "Bob Menamemol", "R. Menamemol",
        "Robert Drapopise", "Wanda Drapopise", "Gabriel Drapopise", "Wanda Sokoruku", "Robert Sokoruku", "Gregory Sokoruku", "Gabriel Sokoruku", "G. Sokoruku", "unknown", "", "Nesofukon Systems Inc", "NESOFUKON SYS", "Nesofukon Systms",
    ]
    e = entities(spark, names)
    gabriel = {n for n in names if e.get(n) is not None and e[n] == e["Gabriel Menamemol"]}
    assert gabriel == {"Gabriel Menamemol", "Gabe Menamemol", "Menamemol, Gabriel C.", "Gabriel Menameoml", "gabrielmenamemol", "gmenamemol", "G. Menamrmol"}
    assert e["Bob Menamemol"] == e["R. Menamemol"] == e["Robert Menamemol"]
    assert e["G. Sokoruku"] is None  # two bear the initial
    assert e["unknown"] is None and e[""] is None
    assert e["NESOFUKON SYS"] == e["Nesofukon Systems Inc"]


def test_turned_names(spark):
    names = ["Agnes Kilanikil", "Helga Kilanikil", "Agnes Linadokem", "Agnes Rototeru", "Helga Rototeru", "Kilanikil Agnes"]
    e = entities(spark, names)
    assert e["Kilanikil Agnes"] == e["Agnes Kilanikil"] != e["Helga Kilanikil"]


def test_pairs(spark):
    rows = spark.createDataFrame([(3, "Agnes Kilanikil", "x"), (1, "A. Kilanikil", "y"), (2, "Helga Rototeru", "z"), (5, None, "z"), (6, "root", "z"), (7, "root", "z"), (8, "Agnes Kilanikil", "x")], "stat_id bigint, author string, entity string")
    got = {tuple(r) for r in m.linked_pairs(rows).collect()}
    assert got == {(1, 3), (1, 8), (3, 8)}
    assert m.entity_rows(rows).count() == rows.count()


def test_no_rows_and_long_names(spark):
    assert m.linked_pairs(spark.createDataFrame([], "stat_id bigint, author string")).count() == 0
    e = entities(spark, ["x" * 5000, "Agnes " + "k" * 3000, "李雷", None])
    assert len(e) == 3


def test_monge_elkan(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["agnes", "kilanikil"], ["agbes", "kilanikil"]), (["agnes", "kilanikil"], ["kilanikil", "agnes"]), (["ab"], ["ba"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(m.monge_elkan(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.9, 1.0, 0.5])


def test_star_clusters(spark):
    nodes = spark.createDataFrame([("hub", 5), ("a", 1), ("b", 1), ("c", 1), ("far", 1), ("alone", 1)], "node string, weight int")
    edges = spark.createDataFrame([("a", "hub", 0.9), ("b", "hub", 0.9), ("c", "hub", 0.9), ("c", "far", 0.95)], "a string, b string, sim double")
    got = {r.node: r.center for r in m.star_clusters(nodes, edges).collect()}
    assert got == {"hub": "hub", "a": "hub", "b": "hub", "c": "hub", "far": "far", "alone": "alone"}


def plain_edits(a, b):
    """Levenshtein distance with one swap of neighbours as 1, by tables."""
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[j] + 1, row[-1] + 1, rows[j - 1] + (x != y)))
        rows = row
    far = rows[-1]
    return 1 if far == 2 and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)) else far


def test_edits(spark):
    pairs = [("abcd", "abdc"), ("abcd", "cbad"), ("abcd", "bacd"), ("ab", "ba"), ("a", "b"), ("", "a"), ("", ""), ("abc", "abcd"), ("abcd", "badc"), ("aabb", "abab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(m.edits(F.col("a"), F.col("b"))).collect()] == [plain_edits(a, b) for a, b in pairs]


def typed(seed, n):
    """Names of few surnames, many with typing errors."""
    import random

    rng = random.Random(seed)
    part = lambda k: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(k))
    people = [(part(rng.choice((2, 3))), s) for s in (part(rng.choice((3, 4))) for _ in range(n // 8)) for _ in range(3)]
    out = set(people)
    while len(out) < n:
        words = list(rng.choice(people))
        for _ in range(rng.choice((1, 1, 2))):
            k = rng.randrange(2)
            w, i = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("aeioknrst") + w[i:], w[:i] + rng.choice("aeioknrst") + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :] if i else w))
        out.add(tuple(words))
    return sorted(out)


def test_recall_of_bands(spark):
    """Of all pairs that Monge-Elkan links, at least 0.99 share a band; and few others do."""
    from pyspark.sql import functions as F

    names = typed(5, 500)
    forms = spark.createDataFrame([(" ".join(w), list(w), "".join(w)) for w in names], "node string, words array<string>, letters string").cache()
    pairs = forms.select(F.col("node").alias("a"), F.col("words").alias("x")).crossJoin(forms.select(F.col("node").alias("b"), F.col("words").alias("y"))).filter("a < b")
    alike = pairs.filter((m.monge_elkan(F.col("x"), F.col("y")) >= m.MONGE_ELKAN) & (m.least_word(F.col("x"), F.col("y")) >= m.WORD_LEAST))
    want = {(r.a, r.b) for r in alike.select("a", "b").collect()}
    got = {tuple(r) for r in m.candidates(forms).collect()}
    assert len(want) > 300
    assert len(want & got) >= 0.99 * len(want)
    assert len(got) < 0.05 * len(names) ** 2 / 2


def test_large_bands_are_spread(spark, monkeypatch):
    names = typed(6, 80)
    forms = spark.createDataFrame([(" ".join(w), "".join(w)) for w in names], "node string, letters string")
    whole = {tuple(r) for r in m.candidates(forms).collect()}
    monkeypatch.setattr(m, "BAND_FORMS", 2)
    assert {tuple(r) for r in m.candidates(forms).collect()} == whole


def test_forms_without_a_name_in_full(spark):
    """Nicknames and initials of a surname without any formal name are linked with their own misspellings."""
    e = entities(spark, ["Lisa Brabatukor", "Lisa Brabatukro", "J. Dodofilam", "J. Dodofilma", "K. Dodofilam", "Agnes Kilanikil"])
    assert e["Lisa Brabatukor"] == e["Lisa Brabatukro"]
    assert e["J. Dodofilam"] == e["J. Dodofilma"] != e["K. Dodofilam"]
    assert None not in e.values()


def test_abbreviations(spark):
    rows = [("chri", "a"), *[("christian", s) for s in "abcdef"], *[("christina", s) for s in "abcde"], ("an", "a"), *[("anna", s) for s in "abcde"], *[("chris", s) for s in "abcde"]]
    got = {r.given: r.longer for r in m.abbreviations(spark.createDataFrame(rows, "given string, surname string")).collect()}
    assert got == {"chri": "chris christian christina"}
