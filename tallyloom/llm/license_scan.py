"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Everything runs in DataFrame functions. A text becomes its lower-case words with single blanks; a coarse
pattern passes the few texts that can match; keywords, then names, choose the rule families of a text; each rule
is one regular expression over the words, and its places are word numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import SEPARATORS, ascii_lower, row_tag, table

# Phrases and labels of the contract (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keywords of which a text must hold one, full title, unambiguous short name or "", SPDX identifier as words.
# Every alternative of title, short name and identifier holds a keyword at the start of a word; for bare names see LEADS.
V = r"(?: v| version)? ?"
FAMILIES = [
    ("mit", "mit licen", r"mit licen[sc]e", "", "mit"),
    ("x11", "x11", r"x11 licen[sc]e", "", "x11"),
    ("isc", "isc licen", r"isc licen[sc]e", "", "isc"),
    ("apache-1", "apache", rf"apache(?: software)? licen[sc]e{V}1(?: [01])?", r"apache 1 [01]", r"apache 1 [01]"),
    ("apache-2", "apache", rf"apache(?: software)? licen[sc]e{V}2(?: 0)?", r"apache 2(?: 0)?", r"apache 2 0"),
    ("bsd-0", "bsd|0bsd", r"(?:0|zero) clause bsd licen[sc]e", "0bsd", "0bsd"),
    ("bsd-2", "bsd|freebsd", r"(?:2|two) clause bsd licen[sc]e|(?:simplified|freebsd) bsd licen[sc]e|freebsd licen[sc]e", r"bsd 2 clause", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd licen[sc]e|(?:new|modified|revised) bsd licen[sc]e", r"bsd 3 clause", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd licen[sc]e|original bsd licen[sc]e", r"bsd 4 clause", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", "", "bsd"),
    ("gpl-1", "general public|gpl", rf"(?:gnu )?general public licen[sc]e{V}1(?: 0)?", r"gpl ?v?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general public|gpl", rf"(?:gnu )?general public licen[sc]e{V}2(?: 0)?", r"gpl ?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public|gpl", rf"(?:gnu )?general public licen[sc]e{V}3(?: 0)?", r"gpl ?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "general public|gpl", r"(?:gnu )?general public licen[sc]e", "gnu gpl", "gpl"),
    ("lgpl-2", "lesser general|library general|lgpl", rf"(?:gnu )?library general public licen[sc]e(?:{V}2(?: 0)?)?", r"lgpl ?v?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general|lgpl", rf"(?:gnu )?lesser general public licen[sc]e{V}2 1", r"lgpl ?v?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser general|lgpl", rf"(?:gnu )?lesser general public licen[sc]e{V}3(?: 0)?", r"lgpl ?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser general|lgpl", r"(?:gnu )?lesser general public licen[sc]e", "gnu lgpl", "lgpl"),
    ("agpl-3", "affero|agpl", rf"(?:gnu )?affero general public licen[sc]e{V}3(?: 0)?", r"agpl ?v?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "affero|agpl", r"(?:gnu )?affero general public licen[sc]e", "gnu agpl", "agpl"),
    ("gfdl", "free documentation|gfdl", r"(?:gnu )?free documentation licen[sc]e", "gfdl", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "mozilla|mpl", rf"mozilla public licen[sc]e{V}1(?: [01])?", r"mpl 1 [01]", r"mpl 1 [01]"),
    ("mpl-2", "mozilla|mpl", rf"mozilla public licen[sc]e{V}2(?: 0)?", r"mpl 2 0", r"mpl 2 0"),
    ("epl-1", "eclipse|epl", rf"eclipse public licen[sc]e{V}1(?: 0)?", r"epl 1 0", r"epl 1 0"),
    ("epl-2", "eclipse|epl", rf"eclipse public licen[sc]e{V}2(?: 0)?", r"epl 2 0", r"epl 2 0"),
    ("cddl-1", "common development|cddl", r"common development and distribution licen[sc]e", r"cddl 1 [01]", r"cddl 1 [01]"),
    ("cpl-1", "common public|cpl 1", r"common public licen[sc]e", r"cpl 1 0", r"cpl 1 0"),
    ("artistic-1", "artistic", rf"artistic licen[sc]e(?:{V}1 0)?", r"artistic 1 0", r"artistic 1 0"),
    ("artistic-2", "artistic", rf"artistic licen[sc]e{V}2(?: 0)?", r"artistic 2 0", r"artistic 2 0"),
    ("boost-1", "boost|bsl", r"boost software licen[sc]e", r"bsl 1 0", r"bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "", "zlib"),
    ("unlicense", "unlicense", r"the unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl|do what the", r"do what the f\S+ you want to public licen[sc]e", "wtfpl", "wtfpl"),
    ("python-2", "python|psf 2", r"python(?: software foundation)? licen[sc]e", r"psf 2 0", r"python 2 0"),
    ("ruby", "ruby", r"ruby licen[sc]e", "", "ruby"),
    ("php-3", "php", r"php licen[sc]e", r"php 3 0[01]?", r"php 3 0[01]?"),
    ("ofl-1", "open font|ofl", r"(?:sil )?open font licen[sc]e", r"ofl 1 [01]", r"ofl 1 [01]"),
    ("eupl", "european union public|eupl", r"european union public licen[sc]e", r"eupl 1 [12]", r"eupl 1 [12]"),
    ("mspl", "microsoft public|ms pl", r"microsoft public licen[sc]e", "ms pl", "ms pl"),
    ("odbl-1", "open database|odbl", r"open database licen[sc]e", r"odbl 1 0", r"odbl 1 0"),
    ("pddl", "pddl|public domain dedication", r"public domain dedication and licen[sc]e", "pddl", r"pddl 1 0"),
    ("cc0", "cc0|creative commons", r"creative commons (?:zero|cc0)", "cc0", r"cc0 1 0"),
    ("cc-by", "cc by|creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[sc]e", r"cc by [1-4] [05]", r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc by|creative commons", r"creative commons attribution share ?alike", r"cc by sa", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by|creative commons", r"creative commons attribution no ?deriv(?:ative|s|atives)", r"cc by nd", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by|creative commons", r"creative commons attribution non ?commercial", r"cc by nc", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by|creative commons", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by|creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)", r"cc by nc nd", r"cc by nc nd [1-4] [05]"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", "", ""),
    ("proprietary", "all rights reserved|proprietary", r"proprietary and confidential|all rights reserved", "", ""),
]

# Priority and wording around a name; a negated grant has the highest and no label, so it silences what it contains.
GRANT = r"(?:is |are )?(?:dual )?(?:licen[sc]ed|released|distributed|redistributed|available|provided|published|offered)"
THE = r"(?:under )?(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
TEMPLATES = [
    (5, "not {grant} {the}{name}", False),
    (4, "spdx licen[sc]e identifier {spdx}", True),
    (3, "{grant} {the}{name}", True),
    (3, "(?:under|to|by) the terms (?:and conditions )?of (?:the )?{name}", True),
    (3, "(?:subject to|governed by|covered by|in accordance with) (?:the )?{name}", True),
    (3, "(?:this|the) (?:work|software|program|library|file|project|document) (?:is|falls) under (?:the )?{name}", True),
    (2, "{title}", True),
    (1, "{short}", True),
]
# Families that count without the word license, and all words that the wording has right before a name.
BARE = ("mit", "isc")
LEADS = (
    "under", "the", "of", "to", "by", "with", "identifier", "licensed", "licenced", "released", "distributed", "redistributed",
    "available", "provided", "published", "offered",
)
WEIGHTS = {1: 0.4, 2: 0.6, 3: 0.85, 4: 1.0}
BASE_WEIGHT = 0.9


def name_of(label: str, title: str, short: str) -> str:
    """The pattern of a family's name in the wordings."""
    return "(?:" + "|".join(x for x in (title, short, title.replace(" licen[sc]e", "") if label in BARE else "") if x) + ")"


def rules() -> list[tuple[int, str, str, int, str, bool]]:
    """(number, family, label, priority, pattern, base) in order; a pattern starts and ends at word borders."""
    out = []
    for phrase, label in BASE.items():
        out.append((len(out), f"base {label}", label, 0, f"(?<= ){phrase}(?= )", True))
    for label, _, title, short, spdx in FAMILIES:
        name = name_of(label, title, short)
        for priority, template, labelled in TEMPLATES:
            parts = {"grant": GRANT, "the": THE, "name": name, "title": f"(?:{title})", "short": short, "spdx": f"(?:{spdx})"}
            if ("{short}" in template and not short) or ("{spdx}" in template and not spdx):
                continue
            pattern = template.format(**parts)
            out.append((len(out), label, label if labelled else "", priority, f"(?<= ){pattern}(?= )", False))
    return out


def names() -> list[tuple[str, str]]:
    """(family, pattern): every match of a rule of the family holds one of its pattern, the name or the SPDX identifier."""
    base = [(f"base {label}", f"(?<= ){phrase}(?= )") for phrase, label in BASE.items()]
    spdx_of = lambda spdx: f"|identifier (?:{spdx})" if spdx else ""
    return base + [(label, f"(?<= )(?:{name_of(label, title, short)}{spdx_of(spdx)})(?= )") for label, _, title, short, spdx in FAMILIES]


def keywords() -> list[tuple[str, str]]:
    """(family, keyword) of the prefilter; a keyword begins with the blank before its first word."""
    base = [(f"base {label}", f" {phrase}") for phrase, label in BASE.items()]
    bare = [(label, f" {lead} {label} ") for label in BARE for lead in LEADS]
    return base + [(label, f" {word}") for label, words, *_ in FAMILIES for word in words.split("|")] + bare


def any_of(words: set[str]) -> str:
    """A pattern of all words, with shared beginnings once: at a place, most are ruled out by one letter."""
    heads = {}
    for word in words:
        heads.setdefault(word[:1], set()).add(word[1:])
    parts = [] if "" in heads else [head + any_of(rest) for head, rest in sorted(heads.items())]
    return f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)


def gate() -> str:
    """Texts without any of these between blanks match no rule: every keyword, without regard to case."""
    return "(?i)" + any_of({word for _, word in keywords()})


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def find_rules(rows: DataFrame) -> DataFrame:
    """id, tag, rule, label, priority, base, start, stop: every place of every rule, in word numbers.

    `rows` has id, tag and words (one blank between words). Places of one rule do not overlap.
    """
    spark = rows.sparkSession
    table_of = spark.createDataFrame(rules(), "rule int, family string, label string, priority int, pattern string, base boolean")
    named = spark.createDataFrame(names(), "family string, name string")
    listed = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(k).alias("keyword")) for f, k in keywords()))
    between = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    low = rows.where(between(F.col("words")).rlike(gate())).select("id", "tag", between(ascii_lower(F.col("words"))).alias("low")).distinct()
    families = F.array_distinct(F.transform(F.filter(listed, lambda k: F.contains(F.col("low"), k["keyword"])), lambda k: k["family"]))
    passed = low.select("id", "tag", "low", F.explode(families).alias("family")).join(F.broadcast(named), "family")
    tried = passed.where(F.rlike("low", F.col("name"))).join(F.broadcast(table_of), "family")
    found = tried.select(
        "id", "tag", "rule", "label", "priority", "base",
        F.split("low", F.col("pattern")).alias("between"), F.regexp_extract_all("low", F.col("pattern"), F.lit(0)).alias("hits"),
    ).where(F.size("hits") > 0)
    each = found.select("id", "tag", "rule", "label", "priority", "base", F.posexplode(F.arrays_zip("between", "hits")).alias("at", "part"))
    order = Window.partitionBy("id", "tag", "rule").orderBy("at")
    ahead = F.sum(blanks(F.col("part.between"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(F.sum(blanks(F.col("part.hits"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (ahead + inside - 1).cast("long")
    return each.select(
        "id", "tag", "rule", "label", "priority", "base", "part", start.alias("start")
    ).where("part.hits is not null").select(
        "id", "tag", "rule", "label", "priority", "base", "start", (F.col("start") + blanks(F.col("part.hits")) + 1).alias("stop")
    )


def resolve(places: DataFrame) -> DataFrame:
    """`places` with `kept`: false for a place inside another one of a higher priority, or of the same and longer or earlier in the rules.
    Base places are kept and silence none: their priority is below all others.

    Sorted by start, longer first, every place that can contain another comes before it, so one running
    maximum of the ends for each priority decides; no two places are compared.
    """
    order = (
        Window.partitionBy("id", "tag").orderBy("start", F.desc("stop"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.lit(False)
    for level in sorted({priority for priority, _, _ in TEMPLATES}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(order)
        inside = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("stop"), F.lit(False))).otherwise(inside)
    return places.withColumn("kept", ~inside)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of `docs`.

    Defined results: a null text is empty; rows that share a doc_id are scanned one by one, equal rows get
    equal results; a null doc_id is scanned like any other; other columns are not read. The score is the
    highest weight of what was found, 0 if nothing was.
    """
    rows = docs.select(
        "doc_id", F.struct(F.col("doc_id").alias("id")).alias("id"), row_tag(F.coalesce("text", F.lit(""))).alias("tag"),
        F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SEPARATORS, " ")).alias("words"),
    )
    places = find_rules(rows)
    weight = F.coalesce(F.when(F.col("base"), BASE_WEIGHT), *(F.when(F.col("priority") == k, w) for k, w in WEIGHTS.items()), F.lit(0.0))
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    found = resolve(places).where("kept and label <> ''").groupBy("id", "tag").agg(
        F.count(of_base("start")).alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(of_base("label"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max(weight).alias("score"),
    )
    n_words = F.when(F.col("words") == "", 0).otherwise(blanks(F.col("words")) + 1).cast("long")
    return rows.select("doc_id", "id", "tag", n_words.alias("n_words")).join(found, ["id", "tag"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
