"""Variant spellings of one person or organisation, linked.

Typed names are reduced to forms: full (given and surname), short (initial and surname), nick (nickname and surname), handle
(one word) and org. Distinct forms, not rows, are compared: padded q-grams of their letters go into MinHash bands whose number
comes from the collision curve; a shared band makes a candidate, Monge-Elkan similarity over the words verifies it, and
star clustering around the best supported forms makes the groups. Short forms, nicknames and handles join the one group
of their surname that bears the initial or name, and none if several do.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm import shingling
from diffloom.session import cut

#: Letters of a q-gram, rows of a band, and the similarity of which a share of at least RECALL must meet in a band. Of 1253 pairs
#: of 4976 forms that Monge-Elkan links, 5 % are less similar than 0.6; fewer rows, at the same recall, give many more candidates.
Q, ROWS, SIMILAR, RECALL = 2, 5, 0.55, 0.99
#: Forms in a band from which on its pairs are made in several tasks.
BAND_FORMS = 1000
#: Least Monge-Elkan similarity of two forms, and least similarity of each pair of words.
MONGE_ELKAN, WORD_LEAST = 0.84, 0.7
#: Two spellings of a word that both occur so often, and not much more rarely one than the other, are two words.
ESTABLISHED, RARER = 3, 0.25

# Names that mean nobody, without signs and blanks.
NOBODY = set(
    "unknown unknownauthor unknownuser unknowncommitter anonymous anon nobody noone none null nil na nan noauthor noname noneofthem root user users admin "
    "administrator yourname yourfullname name author committer system test tester default guest me undefined unnamed notset notspecified tbd todo noreply "
    "nouser emptyname empty localhost changeme someone somebody xxx daemon www wwwdata ci bot build builder git dev developer johndoe unassigned missing".split()
)
# Words of organisations' names with their short forms, and legal forms.
ORG_WORDS = {
    "systems": "sys syst system", "research": "rsch res", "software": "soft sw softw", "foundation": "found fdn fndn", "consulting": "consult cons cnslt", "labs": "lab laboratories laboratory lb",
    "technologies": "tech technology techn", "solutions": "sol solns solution", "services": "svc svcs service serv", "group": "grp", "institute": "inst", "university": "univ uni",
    "international": "intl", "industries": "ind", "networks": "net netw network", "engineering": "eng engr", "digital": "dig", "data": "", "media": "", "studios": "studio",
    "project": "proj", "team": "", "association": "assoc assn", "corporation": "corp", "company": "",
}
ORG_LONG = {short: word for word, shorts in ORG_WORDS.items() for short in (word, *shorts.split())}
LEGAL = set("ltd inc llc gmbh co corp ag sa sarl bv plc kg oy ab limited incorporated srl spa pty kk ev the and of".split())
LEGAL_FORMS = LEGAL - {"the", "and", "of"}
# Nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alexander", "alex": "alexander alexandra alexis", "andy": "andrew", "barb": "barbara", "becca": "rebecca", "becky": "rebecca",
    "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christian christine christina", "chuck": "charles", "dan": "daniel", "danny": "daniel",
    "dave": "david", "dick": "richard", "don": "donald", "doug": "douglas", "ed": "edward edwin edmund", "eddie": "edward", "eliza": "elizabeth",
    "fran": "francesca frances francis", "frank": "francis franklin", "fred": "frederick alfred", "freddie": "frederick", "gabe": "gabriel", "gabby": "gabriela gabrielle", 
    "greg": "gregory", "gus": "gustav august", "harry": "harold henry", "jack": "john jackson", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer",
    "jenny": "jennifer", "jess": "jessica", "jessie": "jessica", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua",
    "kate": "katherine catherine", "kathy": "katherine kathleen", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "kit": "christopher katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
    "leo": "leonard leopold", "liz": "elizabeth", "lizzie": "elizabeth", "maggie": "margaret", "marge": "margaret", "matt": "matthew", "max": "maximilian maxwell",
    "meg": "margaret", "mel": "melvin melanie", "mick": "michael", "mike": "michael", "mitch": "mitchell", "nat": "nathaniel nathan natalie", "nate": "nathaniel nathan", "ned": "edward edmund",
    "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas nicole", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", 
    "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "ronnie": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "sandra alexander alexandra",
    "sanna": "susanna", "sasha": "alexander alexandra", "stan": "stanley", "steph": "stephanie", "steve": "stephen steven", "sue": "susan susanna", "susie": "susan susanna", "ted": "theodore edward",
    "kat": "katherine", "kay": "katherine", "kitty": "katherine", "kris": "christopher christine", "topher": "christopher", "mat": "matthew", "matty": "matthew", "marty": "martin", "nic": "nicholas", "nik": "nicholas", "nico": "nicholas nicole",
    "nora": "eleanor", "ellie": "eleanor elizabeth", "ollie": "oliver", "paddy": "patrick", "russ": "russell", "seb": "sebastian", "stef": "stefan stephanie", "stevie": "stephen steven", "tina": "christina valentina martina", "tori": "victoria",
    "vicki": "victoria", "vikki": "victoria", "libby": "elizabeth", "bess": "elizabeth", "betsy": "elizabeth", "lisa": "elizabeth", "elsie": "elizabeth", "franny": "francesca frances", "frankie": "francesca frances francis", "chess": "francesca",
    "cesca": "francesca", "rita": "margaret", "madge": "margaret", "mags": "margaret", "maisie": "margaret", "greta": "margaret", "peg": "margaret", "dima": "dmitri", "mitya": "dmitri", "misha": "mikhail michael", "katya": "katherine ekaterina",
    "grisha": "gregory grigori", "uli": "ulrich", "fritz": "friedrich frederick", "freddy": "frederick", "zosia": "zofia", "alec": "alexander", "lex": "alexander alexandra", "sacha": "alexander alexandra", "xander": "alexander", "bert": "albert robert herbert",
    "robin": "robert", "dom": "dominic", "liam": "william", "willy": "william", "bex": "rebecca", "jenna": "jennifer", "jenni": "jennifer", "jonny": "jonathan", "nathan": "jonathan nathaniel", "teddy": "theodore edward", "eddy": "edward", "ant": "anthony",
    "tricia": "patricia", "trisha": "patricia", "zanna": "susanna", "suzy": "susan susanna", "dani": "daniel daniela", "gabi": "gabriel gabriela", "benji": "benjamin", "joss": "joseph", "timo": "timothy",
    "terry": "terence theresa", "tess": "theresa", "theo": "theodore", "tim": "timothy", "timmy": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "antonia", "tony": "anthony antonio", "trish": "patricia",
    "val": "valentina valerie valentine", "vic": "victor victoria", "vicky": "victoria", "vince": "vincent", "walt": "walter", "wes": "wesley", "will": "william", "zach": "zachary",
}

_NOISE = re.compile(r"<[^>]*>|\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|[<(\[].*$|\s[@|].*$|\s[-–—]\s.*$|\bvia\s.*$")
_SPLIT = re.compile(r"[^a-z0-9]+")


def bands_for(similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands after which two sets of this Jaccard similarity share one with this probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold()).translate(_LETTERS)
    return "".join(ch for ch in text if not unicodedata.combining(ch))


def parse(name: str | None) -> tuple[str, list[str], bool]:
    """(kind, words, whether the order is sure) of a typed name.

    kind is nobody, org, full (given, surname), short (initial, surname), handle (one word) or other (words that fit none).
    """
    raw = (name or "").strip()
    text = fold(_NOISE.sub(" ", raw)).strip(" .,;:-_@")
    if not text:  # all in brackets: the mailbox, if it is an address
        mail = re.search(r"([\w.+-]+)@", raw)
        text = fold(mail[1]) if mail else ""
    if "@" in text:
        text = text.split("@")[0]
    if _SPLIT.sub("", text) in NOBODY or not re.search(r"[^\W\d_]", text):
        return "nobody", [], False
    comma = "," in text
    words = [w for w in _SPLIT.split(text) if w]
    if not words:  # letters of other scripts only
        return "handle", [re.sub(r"\W+", "", text)], False
    content = [w for w in words if w not in LEGAL]
    if len(words) > 1 and ((any(w in ORG_LONG and len(w) > 2 for w in content) and len(content) > 1) or (words[0] == "the" and content)):
        long = sorted({ORG_LONG.get(w, w) for w in content})
        return "org", long, True
    if len(words) > 1 and words[-1] in LEGAL_FORMS and len(words[-1]) > 2 and content:
        return "org", sorted(set(content)), True
    if comma:
        last, _, first = text.partition(",")
        last_words, first_words = ([w for w in _SPLIT.split(x) if w] for x in (last, first))
        if last_words and first_words:
            words = first_words + last_words
        else:
            comma = False
    long = [w for w in words if len(w) > 1]
    initials = [w for w in words if len(w) == 1]
    if len(long) >= 2:
        return "full", [long[0], long[-1]], comma
    if len(long) == 1:
        return ("short", [initials[0], long[0]], True) if initials else ("handle", long, False)
    return "other", words, False


def grams(letters: str) -> list[str]:
    padded = "^" * (Q - 1) + letters + "$" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(a, *parse(a)) for a in pdf["author"]]
        yield pd.DataFrame(rows, columns=["author", "kind", "words", "sure"])


def with_bands(strings: DataFrame, column: str = "letters") -> DataFrame:
    """``strings`` with ``band``, one row for each band of the padded q-grams of ``column``."""
    n = bands_for()
    a, b = shingling.seeds(n * ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [shingling.bands(shingling.minhash(np.unique(shingling.word_hashes(grams(t))), a, b), ROWS) for t in pdf[column]]
            yield pdf.assign(bands=keys)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strings.schema.fields)
    return strings.mapInPandas(run, f"{kinds}, bands array<bigint>").withColumn("band", F.explode("bands")).drop("bands")


def edits(a: Column, b: Column) -> Column:
    """Levenshtein distance, where a swap of neighbours counts 1."""
    swaps = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    far = F.levenshtein(a, b)
    return F.when((far == 2) & (F.length(a) == F.length(b)), F.when(swaps, 1).otherwise(2)).otherwise(far)


def likeness(a: Column, b: Column) -> Column:
    return 1 - edits(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def monge_elkan(a: Column, b: Column) -> Column:
    """Monge-Elkan similarity of two lists of words: the mean of each word's best likeness, in both directions."""

    def one(x: Column, y: Column) -> Column:
        best = F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: likeness(u, v))))
        return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(x)

    return (one(a, b) + one(b, a)) / 2


def least_word(a: Column, b: Column) -> Column:
    """The least of the best likenesses, in both directions."""

    def one(x: Column, y: Column) -> Column:
        return F.array_min(F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: likeness(u, v)))))

    return F.least(one(a, b), one(b, a))


def oriented(full: DataFrame) -> DataFrame:
    """``full`` forms (words, sure, n) as (given, surname, n), each once.

    Typed orders are turned round where the words stand the other way in most other names.
    """
    first, last = F.col("words")[0], F.col("words")[1]
    places = full.select(F.explode(F.array(F.struct(first.alias("w"), F.lit(1).alias("g")), F.struct(last.alias("w"), F.lit(0).alias("g")))).alias("x"), "sure")
    stats = places.groupBy("x.w").agg(F.sum("x.g").alias("g"), F.sum(1 - F.col("x.g")).alias("s"))
    odds = F.log((F.col("g") + 0.5) / (F.col("s") + 0.5))
    stats = cut(stats.select("w", odds.alias("odds")))
    x = full.select("words", "sure", "n", first.alias("a"), last.alias("b"))
    x = x.join(stats.select(F.col("w").alias("a"), F.col("odds").alias("oa")), "a").join(stats.select(F.col("w").alias("b"), F.col("odds").alias("ob")), "b")
    turn = ~F.col("sure") & (F.col("oa") - F.col("ob") < -1.0)
    x = x.select("words", "sure", "n", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("given"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("surname"))
    return x.select("words", "sure", "given", "surname", "n")


#: Least letters of a given name that counts as another one cut short.
CUT_LEAST = 3


def abbreviations(full: DataFrame) -> DataFrame:
    """(given, longer): given names that begin another one, which is borne by far more surnames; the longer ones in one text."""
    borne = cut(full.groupBy("given").agg(F.countDistinct("surname").alias("c")))
    # each name under all its beginnings: a join on the whole shorter name, as many rows as there are letters
    heads = F.transform(F.sequence(F.lit(CUT_LEAST), F.length("given") - 1), lambda i: F.substr("given", F.lit(1), i))
    long = borne.filter(F.length("given") > CUT_LEAST).select(F.col("given").alias("long"), F.col("c").alias("n"), F.explode(heads).alias("given"))
    both = borne.join(long, "given").filter(F.col("c") <= RARER * F.col("n"))
    return both.groupBy("given").agg(F.concat_ws(" ", F.sort_array(F.collect_set("long"))).alias("longer"))


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, center) of every node of ``nodes`` (node, weight) under ``edges`` (a, b, sim), undirected and each once.

    Of the nodes that have no better neighbour left undecided, each becomes a center; its undecided neighbours become its
    satellites, at the likeliest center. Better is of greater weight, then of more neighbours, then first by name. Rounds
    go on until every node is decided; each round is a few joins.
    """
    both = cut(edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    ranked = nodes.join(degree, nodes["node"] == degree["a"], "left").select("node", F.struct(F.col("weight").cast("double").alias("w"), F.coalesce("degree", F.lit(0)).alias("d"), "node").alias("rank"))
    ranked = cut(ranked)
    r = lambda who, name: ranked.select(F.col("node").alias(who), F.col("rank").alias(name))
    both = cut(both.join(r("a", "ra"), "a").join(r("b", "rb"), "b"))
    alone = ranked.select("node").join(both.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    decided = [alone.select("node", F.col("node").alias("center"))]
    left = both
    while not left.isEmpty():
        best = left.groupBy("a", "ra").agg(F.max("rb").alias("top"))
        centers = cut(best.filter(F.col("ra") > F.col("top")).select(F.col("a").alias("node")))
        hit = left.join(centers.select(F.col("node").alias("b")), "b")
        satellites = hit.groupBy("a").agg(F.max_by("b", F.struct("sim", "rb")).alias("center")).select(F.col("a").alias("node"), "center")
        found = cut(centers.select("node", F.col("node").alias("center")).unionByName(satellites))
        decided.append(found)
        gone = found.select("node")
        rest = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        rest = cut(rest)
        # nodes whose neighbours are all decided stand alone
        freed = left.select(F.col("a").alias("node")).distinct().join(gone, "node", "left_anti").join(rest.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        decided.append(cut(freed.select("node", F.col("node").alias("center"))))
        left = rest
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out


def spread(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of ``keyed`` (node, band) with itself on (band, part): the pairs of a large band are made in several tasks."""
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = keyed.join(sizes, "band").withColumn("parts", F.ceil(F.col("n") / BAND_FORMS).cast("int"))
    left = sized.select("band", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    right = sized.select("band", F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left, right


def candidates(forms: DataFrame) -> DataFrame:
    """(a, b) of forms (node, letters) that share a band, each once. Forms are distinct, so equal names meet only once."""
    left, right = spread(cut(with_bands(forms.select("node", "letters"))))
    return left.join(right, ["band", "part"]).filter("a < b").select("a", "b").distinct()


def _linked(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verified edges (a, b, sim) among ``forms`` (node, words, counts of each word)."""
    side = lambda k: forms.select(F.col("node").alias(k), F.col("words").alias(f"w{k}"), F.col("support").alias(f"s{k}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.size("wa") == F.size("wb"))
    x = x.withColumn("sim", monge_elkan(F.col("wa"), F.col("wb"))).filter(F.col("sim") >= MONGE_ELKAN)
    x = x.filter(least_word(F.col("wa"), F.col("wb")) >= WORD_LEAST)
    # two established spellings in one place are two names
    two = F.exists(
        F.arrays_zip("wa", "wb", "sa", "sb"),
        lambda z: (z["wa"] != z["wb"]) & (F.least(z["sa"], z["sb"]) >= ESTABLISHED) & (F.least(z["sa"], z["sb"]) > RARER * F.greatest(z["sa"], z["sb"])),
    )
    return x.filter(~two).select("a", "b", "sim")


def _supported(forms: DataFrame) -> DataFrame:
    """``forms`` (node, words, n) with support: for each word in its place, the number of different forms that bear it."""
    places = forms.select("node", F.posexplode("words").alias("place", "w"))
    counts = places.groupBy("place", "w").agg(F.count(F.lit(1)).alias("c"))
    support = places.join(counts, ["place", "w"]).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda z: z["c"]).alias("support"))
    return forms.join(support, "node")


def _clustered(forms: DataFrame) -> DataFrame:
    """(node, center) of ``forms`` (node, words, letters, n)."""
    known = cut(_supported(forms))
    edges = cut(_linked(known, candidates(known)))
    # a right spelling is borne by more rows, and its words by more names
    weight = F.col("n") + F.aggregate(F.transform("support", lambda c: F.log2(c + F.lit(1.0))), F.lit(0.0), lambda s, v: s + v)
    return star_clusters(known.select("node", weight.alias("weight")), edges)


def link_names(authors: DataFrame) -> DataFrame:
    """(author, entity) of every distinct spelling in ``authors`` (author) that means a person or organisation.

    entity is null for spellings that mean nobody, and for short forms, nicknames and handles that fit several. A spelling
    that fits none of the known names is an entity with the equal ones only. Blank and null names mean nobody. Any number of rows,
    repeated or not, gives one row per spelling; an empty table gives none.
    """
    typed = authors.filter("author IS NOT NULL").groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    parsed = typed.select("author").mapInPandas(_parse, "author string, kind string, words array<string>, sure boolean")
    parsed = cut(parsed.join(typed, "author"))

    full = oriented(parsed.filter("kind = 'full'").groupBy("words", "sure").agg(F.sum("n").alias("n")))
    nicks = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() if v for x in (k, v)])
    full = cut(full.join(abbreviations(full), "given", "left").withColumn("formal", F.coalesce(nicks[F.col("given")], "longer")).drop("longer"))
    nick, plain = full.filter("formal IS NOT NULL"), full.filter("formal IS NULL")
    people = plain.groupBy("given", "surname").agg(F.sum("n").alias("n"))
    people = people.select(F.concat_ws(" ", "given", "surname").alias("node"), F.array("given", "surname").alias("words"), F.concat("given", "surname").alias("letters"), "n")
    clustered = cut(_clustered(people))

    # targets: the letters of each name in full, and of its initial and surname; with its center if that is the only one
    at = clustered.select("center", F.split("node", " ").alias("w"))
    ends = at.select("center", F.explode(F.array(
        F.struct(F.lit("full").alias("way"), F.concat(F.col("w")[0], F.col("w")[1]).alias("letters"), F.col("w")[0].alias("given"), F.col("w")[1].alias("surname")),
        F.struct(F.lit("short").alias("way"), F.concat(F.substring(F.col("w")[0], 1, 1), F.col("w")[1]).alias("letters"), F.substring(F.col("w")[0], 1, 1).alias("given"), F.col("w")[1].alias("surname")),
    )).alias("t")).select("center", "t.*")
    targets = cut(ends.groupBy("way", "letters").agg(F.min("center").alias("center"), F.countDistinct("center").alias("bearers"), F.min("given").alias("given"), F.min("surname").alias("surname")))

    short = parsed.filter("kind = 'short'").select(F.concat_ws(" ", "words").alias("form"), F.lit("short").alias("way"), F.concat(F.col("words")[0], F.col("words")[1]).alias("letters"), F.col("words")[0].alias("given"), F.col("words")[1].alias("surname"), "words")
    handle = parsed.filter("kind = 'handle'").select(F.concat(F.lit("@"), F.col("words")[0]).alias("form"), F.explode(F.array(F.lit("full"), F.lit("short"))).alias("way"), F.col("words")[0].alias("letters"), "words")
    handle = handle.select("form", "way", "letters", F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("surname"), "words")
    named = nick.select(F.concat_ws(" ", "given", "surname").alias("form"), F.lit("full").alias("way"), F.explode(F.split("formal", " ")).alias("given"), "surname", F.array("given", "surname").alias("words"))
    named = named.select("form", "way", F.concat("given", "surname").alias("letters"), "given", "surname", "words")
    seekers = cut(short.unionByName(handle).unionByName(named).distinct())
    joined = cut(_attached(seekers, targets))

    # those that meet no target are linked among themselves
    alone = cut(seekers.select("form", "words").distinct().join(joined, "form", "left_anti").groupBy("form").agg(F.min("words").alias("words")))
    own = _clustered(alone.select(F.concat(F.lit("~"), "form").alias("node"), "words", F.concat_ws("", "words").alias("letters"), F.lit(1).alias("n")))
    loose = joined.select("form", F.when(F.col("bearers") == 1, F.col("center")).alias("entity")).unionByName(own.select(F.expr("substr(node, 2)").alias("form"), F.col("center").alias("entity")))
    loose = cut(loose)
    people_of = full.filter("formal IS NULL").select("words", "sure", F.concat_ws(" ", "given", "surname").alias("node")).join(clustered, "node").select("words", "sure", F.col("center").alias("entity"))
    nick_of = nick.select("words", "sure", F.concat_ws(" ", "given", "surname").alias("form")).join(loose, "form").select("words", "sure", "entity")
    full_of = parsed.filter("kind = 'full'").join(people_of.unionByName(nick_of), ["words", "sure"]).select("author", "entity")
    form = F.when(F.col("kind") == "short", F.concat_ws(" ", "words")).otherwise(F.concat(F.lit("@"), F.col("words")[0]))
    loose_of = parsed.filter("kind IN ('short', 'handle')").withColumn("form", form).join(loose, "form").select("author", "entity")
    org = parsed.filter("kind = 'org'").groupBy("words").agg(F.sum("n").alias("n"))
    org = org.select(F.concat(F.lit("& "), F.concat_ws(" ", "words")).alias("node"), "words", F.concat_ws("", "words").alias("letters"), "n")
    org_of = parsed.filter("kind = 'org'").withColumn("node", F.concat(F.lit("& "), F.concat_ws(" ", "words"))).join(_clustered(org), "node").select("author", F.col("center").alias("entity"))
    rest = parsed.filter("kind IN ('nobody', 'other')").select("author", F.lit(None).cast("string").alias("entity"))
    return full_of.unionByName(loose_of).unionByName(org_of).unionByName(rest)


def _attached(seekers: DataFrame, targets: DataFrame) -> DataFrame:
    """(form, center, bearers) of the seekers (form, way, letters, given, surname) that meet a target.

    A target is met if a band is shared and the Monge-Elkan similarity is at least MONGE_ELKAN; as so little of a name is
    there, the letters must also be one edit apart at most, from the same first letter. Of the targets met the likeliest
    counts, a full one before a short one. bearers is over 1 if several centers are equally near.
    """
    have = with_bands(targets).select("band", "way", F.col("letters").alias("t"), "center", "bearers", F.col("given").alias("tg"), F.col("surname").alias("ts"))
    want = cut(with_bands(seekers.select("form", "way", "letters", "given", "surname")))
    # many forms in one band: each part of them meets the band's targets in a task of its own
    sizes = want.groupBy("band", "way").agg(F.ceil(F.count(F.lit(1)) / BAND_FORMS).cast("int").alias("parts"))
    want = want.join(sizes, ["band", "way"]).withColumn("part", F.pmod(F.xxhash64("form"), "parts").cast("int"))
    have = have.join(sizes, ["band", "way"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = want.join(have, ["band", "way", "part"]).drop("band", "part", "parts").distinct()
    words = lambda given, surname, letters: F.when(F.col("surname").isNull(), F.array(letters)).otherwise(F.array(given, surname))
    alike = monge_elkan(words("given", "surname", "letters"), words("tg", "ts", "t"))
    far = edits(F.col("letters"), F.col("t"))
    fits = F.when(F.col("surname").isNull(), F.length("t") > 4).otherwise(
        (edits(F.col("surname"), F.col("ts")) <= 1) & F.when(F.col("way") == "short", F.col("given") == F.col("tg")).otherwise(edits(F.col("given"), F.col("tg")) <= 1)
    )
    met = met.filter(F.substring("letters", 1, 1) == F.substring("t", 1, 1)).withColumn("far", far).filter((F.col("far") <= 1) & (alike >= MONGE_ELKAN) & fits)
    near = F.col("far") * 2 + F.when(F.col("way") == "full", 0).otherwise(1)
    w = Window.partitionBy("form").orderBy("near")
    best = met.withColumn("near", near).withColumn("rank", F.rank().over(w)).filter("rank = 1")
    return best.groupBy("form").agg(F.min("center").alias("center"), F.greatest(F.max("bearers"), F.countDistinct("center")).alias("bearers"))


def entity_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with their entity: every row of ``rows`` (author, ...) once, null where its name means nobody. A column named entity is replaced."""
    links = link_names(rows.select("author")).withColumnRenamed("author", "_author")
    return rows.drop("entity").join(links, rows["author"] == links["_author"], "left").drop("_author")


def linked_pairs(rows: DataFrame, key: str = "stat_id") -> DataFrame:
    """(``key``_a, ``key``_b), a < b, of all rows that mean the same person or organisation."""
    known = cut(entity_rows(rows.select(key, "author")).filter("entity IS NOT NULL").select(key, "entity").distinct())
    a, b = known.withColumnRenamed(key, f"{key}_a"), known.withColumnRenamed(key, f"{key}_b")
    return a.join(b, "entity").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
