"""Variant spellings of names typed by people (problem 7).

Method: every name is rewritten by rules for titles, case, diacritics, hyphens, token order, nicknames, initials,
one typing error, and, for organisations, legal forms, articles and acronyms. The rewritings are exploded and
equi-joined. A shared rewriting counts by its rarity: one that leads to a single person links, one that
fits several persons (such as an initial with a frequent family name) does not, unless a middle
initial or the exact spelling leaves one of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirelake.llm.components import components
from quirelake.llm.titles import fold
from quirelake.session import spool

# Nicknames with the given names they may stand for, the most usual first.
NICKNAMES = {
    k: tuple(v.split())
    for k, v in {
        "abby": "abigail", "al": "albert alan alfred alexander", "alex": "alexander alexandra alexis", "andy": "andrew andreas", "annie": "anne anna", "becky": "rebecca", "beppe": "giuseppe", "ben": "benjamin benedict", "bert": "albert robert herbert",
        "beth": "elizabeth bethany", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "katherine", "charlie": "charles charlotte", "chris": "christopher christine christian christina", "chuck": "charles",
        "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "ed": "edgar edward edwin edmund", "eddie": "edgar edward edwin edmund", "fran": "frances francis", "frank": "franklin francis",
        "fred": "frederick alfred", "gabe": "gabriel", "gene": "eugene", "greg": "gregor gregory", "hannes": "johannes", "jack": "john", "jen": "jennifer", "jenny": "jennifer", "jeff": "jeffrey", "jerry": "gerald jerome", "jim": "james", "jimmy": "james", "joe": "joseph",
        "kate": "katherine", "kathy": "katherine", "katya": "ekaterina", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "maggie": "margaret", "mandy": "amanda", "matt": "matthew matthias", "meg": "margaret", "mike": "michael", "misha": "mikhail", "mitch": "mitchell",
        "nick": "nicholas nikolai", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "rafa": "rafael", "ray": "raymond", "rich": "richard", "rick": "richard eric",
        "rob": "robert", "ron": "ronald", "sacha": "alexander", "sam": "samuel samantha", "sandy": "alexandra alexander sandra", "sasha": "alexander alexandra", "steve": "stephen steven", "sue": "susan suzanne", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas",
        "tommy": "thomas", "tony": "anthony antonio", "vicky": "victoria", "vicki": "victoria", "vlad": "vladimir", "walt": "walter", "will": "william", "zach": "zachary",
    }.items()
}
#: The most usual given name of each.
GIVEN = {k: v[0] for k, v in NICKNAMES.items()}
# Words of organisations' names with their short forms.
LEGAL_FORMS = {
    "ctr": "center", "centre": "center", "cntr": "center", "lab": "laboratory", "labs": "laboratory", "dept": "department", "dep": "department", "inst": "institute", "cons": "consortium",
    "wg": "working group", "univ": "university", "assoc": "association", "soc": "society", "grp": "group", "intl": "international", "natl": "national", "tech": "technology",
    "corp": "corporation", "co": "company", "inc": "incorporated", "ltd": "limited", "acad": "academy", "fac": "faculty", "coll": "college",
}
_SMALL = frozenset({"the", "of", "for", "on", "and", "in", "at", "to", "a"})
_HEADS = frozenset({"center", "laboratory", "department", "institute", "consortium", "group", "university", "association", "society", "academy", "faculty", "college", "school", "team", "initiative", "council", "network"})
_TITLES = frozenset({"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "jr", "sr", "phd", "md", "ii", "iii", "doctor"})
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ACRONYM = re.compile(r"^([^\W\d_]+)\s+([A-Z]{2,6})$")


Rewritten = tuple[str, str, str, str, list[str], list[str], str, list[str]]


def rewrite(name: str, choice: str = "") -> Rewritten:
    """(kind, key, middle, exact, short, near, literal, options) of a name.

    kind: P a person in full, I a person with an initial for the given name, O an organisation, A an
    organisation's acronym. key: its canonical form. middle: initials besides the first. exact: its words with
    diacritics. short: its forms with an initial or as an acronym. near: its forms with one letter left
    out of one word, and itself, by which names with one typing error meet; after a tab stands the word. options: the
    keys of a nickname that may stand for several given names, and literal its key as it is written; choice
    tells which of these keys it takes, by default the most usual.
    """
    text = name.replace("&", " and ")
    if (m := _ACRONYM.match(text.strip())) and not m[1].isupper():
        lead = fold(m[1])
        return "A", f"{lead}|{m[2].lower()}", "", lead, [f"{lead}|{m[2].lower()}"], [], "", []
    before, comma, after = text.partition(",")
    words = [fold(w) for w in _TOKEN.findall(text)]
    spread = " ".join(LEGAL_FORMS.get(w, w) for w in words).split()
    if _HEADS & set(spread) and len(spread) > 2 or {"of", "for", "on"} & set(words):
        if comma and len(after.split()) == 1:
            words = [fold(w) for w in _TOKEN.findall(after + " " + before)]
            spread = " ".join(LEGAL_FORMS.get(w, w) for w in words).split()
        core = [w for w in spread if w not in _SMALL]
        if core:
            lead, rest = core[0], core[1:]
            acronym = f"{lead}|{''.join(w[0] for w in rest)}"
            return "O", f"{lead}|{' '.join(rest)}", "", lead, [acronym], _near_words(core), "", []
    if comma:
        text = after + " " + before
    tokens: list[str] = []
    for w in text.split():
        w = w.strip(".,;:'\"’")
        low = fold(w)
        if low.strip(".") in _TITLES and len(text.split()) > 1:
            continue
        if re.fullmatch(r"(?:[^\W\d_]\.?[-‐]?){2,3}", w) and ("." in w or "-" in w) or len(w) == 1:
            # initials of one hyphenated given name (J.-L.) count as one
            tokens += [c for part in fold(w).split(".") for c in re.sub(r"[^a-z]", "", part)[:1] if not part.startswith("-")] if "-" in w else [c for c in fold(w) if c.isalpha()]
        else:
            tokens.append(re.sub(r"[-‐‑'’.]", "", w).lower())
    full = [t for t in tokens if len(t) > 1]
    initials = [fold(t) for t in tokens if len(t) == 1]
    if len(full) > 2:
        full = ["".join(full[:-1]), full[-1]]
    if len(full) == 2:
        a, b = (fold(t) for t in full)
        at = 0 if comma or b not in NICKNAMES else 1  # which of the words is the given name
        pair = [a, b]
        meanings = NICKNAMES.get(pair[at], ())
        keys = {}
        for given in meanings or (pair[at],):
            known = list(pair)
            known[at] = given
            keys["|".join(sorted(known))] = known
        literal = "|".join(sorted(pair))
        known = pair if choice == literal else keys.get(choice) or next(iter(keys.values()))
        key = sorted(known)
        short = [f"{known[0][0]}|{known[1]}"] + ([] if comma else [f"{known[1][0]}|{known[0]}"])
        return "P", "|".join(key), "".join(initials), " ".join(full), short, _near_names(key), *((literal, list(keys)) if len(keys) > 1 else ("", []))
    if len(full) == 1 and initials:
        s = fold(full[0])
        return "I", f"{initials[0]}|{s}", "".join(initials[1:]), full[0], [f"{initials[0]}|{s}"], [], "", []
    return "P", "|".join([fold(t) for t in full or tokens or [name.lower()]]), "".join(initials), " ".join(full), [], [], "", []


def _left_out(rest: str, word: str) -> list[str]:
    """The word with one letter left out at each place, and unchanged, after the rest of the name; words of one or two letters have none."""
    return [] if len(word) < 3 else sorted({f"{rest}>{v}\t{word}" for v in [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]})


def _near_names(words: list[str]) -> list[str]:
    return [*_left_out(words[1], words[0]), *_left_out(words[0], words[1])]


def _near_words(words: list[str]) -> list[str]:
    return [f for i, w in enumerate(words) for f in _left_out(" ".join([*words[:i], str(i), *words[i + 1 :]]), w)]


_COLUMNS = ("kind", "key", "middle", "exact", "short", "near", "literal", "options")
_SCHEMA = "author string, n bigint, kind string, key string, middle string, exact string, short array<string>, near array<string>, literal string, options array<string>"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        choices = batch.column("choice").to_pylist()
        got = [rewrite(a, c or "") for a, c in zip(batch.column("author").to_pylist(), choices, strict=True)]
        cols = list(zip(*got, strict=True)) if got else [()] * len(_COLUMNS)
        kinds = [strings if c in ("short", "near", "options") else pa.string() for c in _COLUMNS]
        yield pa.RecordBatch.from_arrays([batch.column("author"), batch.column("n"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["author", "n", *_COLUMNS])


def _parsed(names: DataFrame) -> DataFrame:
    """Each distinct name once with its rewritings. A nickname of several given names takes the one that a name in full has with the rest of it; of several none, and if there is none the most usual."""
    distinct = names.where("author IS NOT NULL AND trim(author) <> ''").groupBy("author").agg(F.count("*").alias("n"))
    first = spool(distinct.withColumn("choice", F.lit("")).mapInArrow(_rewrite, _SCHEMA), "names")
    several = first.where("literal <> ''")
    full = first.where("literal = '' AND kind = 'P'").select("key").distinct()
    fits = several.select("literal", F.explode("options").alias("key")).distinct().join(full, "key").groupBy("literal").agg(F.count("*").alias("fitting"), F.max("key").alias("key"))
    chosen = several.select("author", "n", "literal").join(fits, "literal", "left").select("author", "n", F.when(F.col("fitting") == 1, F.col("key")).when(F.col("fitting") > 1, F.col("literal")).otherwise("").alias("choice"))
    return spool(first.where("literal = ''").unionAll(chosen.mapInArrow(_rewrite, _SCHEMA)).drop("literal", "options"), "names")


def _one_error(a: Column, b: Column) -> Column:
    """One letter more, less or changed, or two neighbours exchanged."""
    d = F.levenshtein(a, b, 2)
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d == 1) | (d == 2) & swapped


def linked_names(names: DataFrame) -> DataFrame:
    """author and group_id of all names linked with another one, from a column author of names (repeated or not).

    Names that differ in case, diacritics, titles, hyphens, token order, nicknames, or by a middle
    initial on one side only, link. A name with a typing error in one word links with the name that has the word
    right, if the wrong word is rarer: it stands with fewer other words. A name with an initial links if
    one person fits. Persons with different middle initials do not link. Nulls and blanks give no row.
    """
    parsed = _parsed(names)
    whole = parsed.where("kind IN ('P', 'O')")
    mids = whole.where("middle <> ''").groupBy("kind", "key").agg(F.min("middle").alias("lo"), F.max("middle").alias("hi"))
    # persons of one key with several middle initials are several persons, told apart by it
    several = mids.where("left(lo, 1) <> left(hi, 1)").select("kind", "key", F.lit(True).alias("several"))
    ident = F.concat_ws(":", F.col("kind"), F.col("key"), F.when(F.coalesce("several", F.lit(False)), F.left("middle", F.lit(1))).otherwise(F.lit("")))
    classed = whole.join(several, ["kind", "key"], "left").withColumn("class", ident)
    classes = spool(classed.groupBy("class", "kind", "key").agg(F.sum("n").alias("n"), F.max("middle").alias("middle"), F.collect_set("exact").alias("exact"), F.max("short").alias("short"), F.max("near").alias("near")), "name-classes")

    near = classes.select("class", "kind", "n", F.explode("near").alias("f")).select("class", "kind", "n", F.substring_index("f", "\t", 1).alias("form"), F.substring_index("f", "\t", -1).alias("word"))
    # how many other words a word stands with
    rest = F.substring_index("form", ">", 1)
    support = near.where(F.col("form") == F.concat(rest, F.lit(">"), F.col("word"))).select("word", rest.alias("other")).distinct().groupBy("word").agg(F.count("*").alias("support"))

    # names of one form differ in one word by a letter; their number is bounded by the letters there are
    pairs = near.alias("a").join(near.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.word") != F.col("b.word")))
    pairs = pairs.select(F.col("a.class").alias("wrong"), F.col("b.class").alias("right"), F.col("a.n").alias("n_wrong"), F.col("b.n").alias("n_right"), F.col("a.word").alias("x"), F.col("b.word").alias("y")).distinct().where(_one_error(F.col("x"), F.col("y")))
    pairs = pairs.join(support.withColumnsRenamed({"word": "x", "support": "sx"}), "x").join(support.withColumnsRenamed({"word": "y", "support": "sy"}), "y")
    rarer = (F.col("sx") <= 2) & (F.col("sx") < F.col("sy")) | (F.col("sx") * 8 <= F.col("sy")) | (F.col("sx") <= 2) & (F.col("sx") == F.col("sy")) & ((F.col("n_wrong") < F.col("n_right")) | (F.col("n_wrong") == F.col("n_right")) & (F.col("wrong") > F.col("right")))
    typos = spool(pairs.where(rarer).groupBy("wrong").agg(F.max_by("right", F.struct("sy", "n_right", "right")).alias("right")), "name-typos")

    # initials and acronyms lead to the persons and organisations that are no typing errors themselves
    right = classes.join(typos, F.col("class") == F.col("wrong"), "left_anti")
    targets = right.select("class", "kind", F.col("middle").alias("m"), F.col("exact").alias("full"), F.explode("short").alias("form")).distinct()
    brief = parsed.where("kind IN ('I', 'A')").select("author", F.when(F.col("kind") == "I", "P").otherwise("O").alias("kind"), "middle", "exact", F.element_at("short", 1).alias("form"))
    fits = brief.join(targets, ["kind", "form"]).where("middle = '' OR m = '' OR left(middle, 1) = left(m, 1)")
    score = F.when((F.col("middle") != "") & (F.col("m") != ""), 2).otherwise(0) + F.when((F.col("kind") == "P") & F.exists("full", lambda f: F.array_contains(F.split(f, " "), F.col("exact"))), 1).otherwise(0)
    ranked = fits.select("author", "class", score.alias("score")).groupBy("author", "score").agg(F.count("*").alias("fitting"), F.max("class").alias("class"))
    best = ranked.groupBy("author").agg(F.max_by(F.struct("fitting", "class"), "score").alias("b")).where("b.fitting = 1").select("author", F.col("b.class").alias("class"))

    # names with the same initial form, none of which has a person in full, are linked by that form
    loose = parsed.where("kind IN ('I', 'A')").join(fits.select("author").distinct(), "author", "left_anti").select("author", F.concat_ws(":", "kind", "key").alias("class"))

    # ids must not meet in case or blanks, as components() does not tell those apart: names become hex
    name = lambda c: F.concat(F.lit("n"), F.hex(F.encode(c, "UTF-8")))
    edges = (
        classed.select(name("author").alias("x"), F.concat(F.lit("k"), F.hex(F.encode("class", "UTF-8"))).alias("y"))
        .unionAll(best.select(name("author"), F.concat(F.lit("k"), F.hex(F.encode("class", "UTF-8")))))
        .unionAll(loose.select(name("author"), F.concat(F.lit("k"), F.hex(F.encode("class", "UTF-8")))))
        .unionAll(typos.select(F.concat(F.lit("k"), F.hex(F.encode("wrong", "UTF-8"))), F.concat(F.lit("k"), F.hex(F.encode("right", "UTF-8")))))
    )
    groups = components(edges, "x", "y").where(F.col("entity_id").startswith("n"))
    return groups.select(F.decode(F.unhex(F.substring("entity_id", 2, 1 << 30)), "UTF-8").alias("author"), "group_id")


def same_names(names: DataFrame) -> DataFrame:
    """name_a and name_b of each pair of different names of one person or organisation, name_a < name_b. See linked_names."""
    groups = spool(linked_names(names), "name-groups")
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.author") < F.col("b.author"))).select(F.col("a.author").alias("name_a"), F.col("b.author").alias("name_b"))
