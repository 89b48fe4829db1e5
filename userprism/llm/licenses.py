"""License scan by ordered signature rules, in SQL functions only.

Text is reduced to words (ASCII letters lower-cased, digits, non-ASCII characters) joined by
spaces. Rules are regular expressions over that, each gated by keywords of which one must occur; a text
without the keywords of all rules is not searched, as no rule could match it. Every match is an interval.
In the order of start, longer first, then rank, a match inside a kept interval of its own or a
better rank is suppressed, so "under the mit license" inside a quoted identifier line does
not count twice. Ranks: identifier tags, grants, links, license text, names.

Three base phrases are counted at every place they stand; their labels stay whatever the rules
suppress. Defined results: a null or empty text has no words, labels or places (0, nulls, "",
score 0.0). Rows, also repeated ones and null ids, are scanned each. Extra columns are not read.
"""

from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licenses: label, identifier as words, keywords (one of them stands in every form of the name), name.
NAMES = (
    ("mit", "mit", " mit | expat | x11 ", "(?:the )?(?:mit|expat|x11)"),
    ("mit-0", "mit 0", " mit 0 | mit no attribution ", "mit (?:no attribution|0)"),
    ("apache-2", "apache 2 0", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache 1 1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("bsd-2-clause", "bsd 2 clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd 3 clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "0bsd", "0bsd|zero clause bsd", "(?:0bsd|zero clause bsd)"),
    ("gpl-2", "gpl 2 0(?: only)?", "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-2+", "gpl 2 0 or later", "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)? or (?:any )?later"),
    ("gpl-3", "gpl 3 0(?: only)?", "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl-3+", "gpl 3 0 or later", "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)? or (?:any )?later"),
    ("gpl-2", "gnu gpl 2", "general public", "gnu general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu gpl 3", "general public", "gnu general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "gnu lgpl 2 1", "lesser general", "gnu lesser general public licen[cs]e(?: version| v)? ?2 1"),
    ("lgpl-3", "gnu lgpl 3", "lesser general", "gnu lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "agpl", "(?:gnu )?agpl(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "gnu agpl 3", "affero", "gnu affero general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "free documentation", "gnu free documentation licen[cs]e(?: version| v)? ?1 3"),
    ("mpl-1.1", "mpl 1 1", "mozilla public", "mozilla public licen[cs]e(?: version| v)? ?1 1"),
    ("mpl-2", "mpl 2 0", "mozilla public", "mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "epl 1 0", "eclipse public", "eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "epl 2 0", "eclipse public", "eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("eupl-1.2", "eupl 1 2", "european union", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("cddl-1", "cddl 1 0", "common development", "common development and distribution licen[cs]e(?: version| v)?(?: 1(?: 0)?)?"),
    ("cpl-1", "cpl 1 0", "common public", "common public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?"),
    ("isc", "isc", " isc ", "isc"),
    ("zlib", "zlib", " zlib ", "zlib(?: libpng)?"),
    ("bsl-1", "bsl 1 0", "boost software", "boost software licen[cs]e(?: version| v)?(?: 1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("artistic-2", "artistic 2 0", "artistic", "artistic(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("python-2", "python 2 0", "python software", "python software foundation(?: licen[cs]e)?(?: version)?(?: 2)?"),
    ("ruby", "ruby", " ruby ", "ruby"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("php-3.01", "php 3 01", " php", "php(?: licen[cs]e)?(?: version| v)? ?3 01"),
    ("ofl-1.1", "ofl 1 1", "open font", "(?:sil )?open font(?: licen[cs]e)?(?: version| v)?(?: 1 1)?"),
    ("ms-pl", "ms pl", "microsoft public", "microsoft public"),
    ("ncsa", "ncsa", "ncsa open source", "(?:university of illinois )?(?:illinois )?ncsa open source"),
    ("afl-3", "afl 3 0", "academic free", "academic free(?: licen[cs]e)?(?: version| v)?(?: 3(?: 0)?)?"),
    ("osl-3", "osl 3 0", "open software", "open software licen[cs]e(?: version| v)?(?: 3(?: 0)?)?"),
    ("odbl-1", "odbl 1 0", "open database", "open (?:data commons open )?database(?: licen[cs]e)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("cc0-1", "cc0 1 0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by [1-4] [05]", "cc by|creative commons attribution", "(?:cc by|creative commons attribution)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa [1-4] [05]", "cc by sa|creative commons attribution share", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd [1-4] [05]", "cc by nd|creative commons attribution no", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc [1-4] [05]", "cc by nc|creative commons attribution non", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", "cc by nc sa|creative commons attribution non", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", "cc by nc nd|creative commons attribution non", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
)

# Links: label, keyword, path as words.
LINKS = (
    ("mit", "opensource org", "opensource org licenses? mit"), ("apache-2", "apache org", "apache org licenses license 2 0"),
    ("bsd-3-clause", "opensource org", "opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource org", "opensource org licenses? bsd 2 clause"),
    ("gpl-3", "gnu org", "gnu org licenses gpl 3 0"), ("gpl-2", "gnu org", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("lgpl-3", "gnu org", "gnu org licenses lgpl 3 0"), ("agpl-3", "gnu org", "gnu org licenses agpl 3 0"),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0"), ("epl-2", "eclipse org", "eclipse org legal epl 2 0"),
    ("unlicense", "unlicense org", "unlicense org"), ("cc0-1", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]"),
)

# Sentences of license texts: label, keyword, words.
TEXTS = (
    ("mit", "hereby granted free", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the names? of .{1,80}? nor the names of (?:its|any) contributors"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software"),
    ("gpl-2+", "at your option any later", "either version 2 of the license or at your option any later version"),
    ("gpl-3+", "at your option any later", "either version 3 of the license or at your option any later version"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("wtfpl", "what the", "do what the fuck you want to public license"),
    ("bsl-1", "accompanying documentation", "obtaining a copy of the software and accompanying documentation covered by this license"),
)

GRANT = (
    "(?:licen[cs]ed|released|distributed|published|available|provided|made available|redistribute it)"
    "(?: [a-z]+){0,2}? (?:under|according to)(?: the)?(?: (?:terms|conditions) of)?(?: the)?"
)


def rules():
    """All rules as (rank, label, keywords, pattern, confidence), in order; keywords are split by |."""
    out = []
    for label, tag, key, name in NAMES:
        out.append((1, label, "spdx", f"spdx license identifier {tag}", 1.0))
        out.append((2, label, key, f"{GRANT} {name}(?: licen[cs]e)?(?: version [0-9]+(?: 0)?)?", 0.95))
        out.append((4, label, key, f"under(?: the)? {name} licen[cs]es?", 0.9))
        # A name that already says license stands alone, a bare word does not.
        whole = "licen[cs]e" in name or key in ("lgpl", "agpl", "gpl", "cc0", "wtfpl", "unlicense") or label.startswith("cc-")
        out.append((5, label, key, f"{name}(?: licen[cs]ed?)?" if whole else f"{name} licen[cs]ed?", 0.7))
    out += [(3, label, key, f"(?:https?)? ?(?:www )?{path}", 0.9) for label, key, path in LINKS]
    out += [(4, label, key, words, 0.85) for label, key, words in TEXTS]
    return out


def _words(text):
    """Words joined by one space."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _count(text):
    """Words in a text in which each stands between two spaces of its own."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _matches(text, gated=True):
    """All matches of all rules: (start, -end, rank, label, confidence, end)."""
    table = F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.array(*map(F.lit, key.split("|"))).alias("keywords"),
                 F.lit(f"(?<= ){pattern}(?= )").alias("pattern"), F.lit(sure).alias("confidence"))
        for rank, label, key, pattern, sure in rules()
    ])

    def places(rule):
        found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        gaps = F.split(text, rule["pattern"], -1)
        kind = "array<struct<start:int,back:int,rank:int,label:string,confidence:double,stop:int>>"
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(done, pair):
            start = (done["at"] + F.length(pair["gap"])).cast("int")
            stop = (start + F.length(pair["hit"])).cast("int")
            hit = F.struct(
                start.alias("start"), (-stop).cast("int").alias("back"), rule["rank"].alias("rank"), rule["label"].alias("label"),
                rule["confidence"].alias("confidence"), stop.alias("stop"),
            )
            return F.struct(stop.alias("at"), F.concat(done["out"], F.array(hit).cast(kind)).alias("out"))

        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, begin, step, lambda done: done["out"])

    able = F.filter(table, lambda rule: F.exists(rule["keywords"], lambda key: F.contains(text, key))) if gated else table
    return F.array_sort(F.flatten(F.transform(able, places)))


RANKS = 5


def _kept(matches):
    """Matches that no match of their own or a better rank contains."""
    kind = "array<struct<start:int,back:int,rank:int,label:string,confidence:double,stop:int>>"
    # The furthest end so far of the matches of each rank or better; matches come sorted by start.
    begin = F.struct(F.array(*[F.lit(-1)] * RANKS).alias("ends"), F.array().cast(kind).alias("out"))

    def step(done, match):
        inside = F.element_at(done["ends"], match["rank"]) >= match["stop"]
        ends = F.transform(
            done["ends"], lambda end, n: F.when(n + 1 >= match["rank"], F.greatest(end, match["stop"])).otherwise(end)
        )
        return F.struct(
            ends.alias("ends"), F.when(inside, done["out"]).otherwise(F.concat(done["out"], F.array(match).cast(kind))).alias("out")
        )

    return F.aggregate(matches, begin, step, lambda done: done["out"])


def detect(docs, text="text", gated=True):
    """``docs`` with ``words`` (see module) and ``licenses``: kept matches as intervals of it.

    Without ``gated`` every text is searched by every rule, with the same result.
    """
    spaced = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    gate = F.lit(not gated)
    for key in sorted({key for rule in rules() for key in rule[2].split("|")}) if gated else ():
        gate = gate | F.contains(spaced, F.lit(key))
    kind = "array<struct<start:int,back:int,rank:int,label:string,confidence:double,stop:int>>"
    found = F.when(gate, _kept(_matches(spaced, gated))).otherwise(F.array().cast(kind))
    return docs.withColumn("words", _words(F.col(text))).withColumn("licenses", found)


def scan(docs, gated=True):
    """One row per document with the base phrases' places and all labels."""
    rows = detect(docs.select("doc_id", "text"), gated=gated)
    # Each word between two spaces of its own, so that neighbouring places share none.
    wide = F.when(F.col("words") == "", "").otherwise(F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" ")))
    rows = rows.select("doc_id", wide.alias("wide"), "licenses").withColumn("n_words", _count(F.col("wide")))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in sorted(BASE.items(), key=lambda item: item[1]):
        n = len(phrase.split())
        words = "".join(f" {w} " for w in phrase.split())
        target = F.lit(words)
        here = F.contains("wide", target)
        gone = F.octet_length("wide") - F.octet_length(F.replace("wide", target, F.lit("")))
        places.append(F.when(here, (gone / F.octet_length(target)).cast("long")).otherwise(0))
        firsts.append(F.when(here, _count(F.substring_index("wide", words, 1))))
        lasts.append(F.when(here, F.col("n_words") - _count(F.substring_index("wide", words, -1)) - n))
        labels.append(F.when(here, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    found = F.array_sort(F.array_distinct(F.concat(base, F.transform("licenses", lambda m: m["label"]))))
    sure = F.coalesce(F.array_max(F.transform("licenses", lambda m: m["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", found).alias("labels"),
        F.greatest(sure, F.when(F.size(base) > 0, 0.9).otherwise(0.0)).alias("score"),
    )
