"""Licence scan: normalised sentences → known sentence identifiers → ordered rules over identifier sequences."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, normalised, with their identifiers.
SENTENCES = {
    "all rights reserved": "AllRights",
    "licensed under the apache license version 2 0": "ApacheRef2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "ApacheNotice2",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this work is licensed under the gnu general public license version 3": "GplRef3",
    "this work is licensed under the gnu general public license version 2": "GplRef2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GplGrant2Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GplGrant3Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarranty",
    "see the gnu general public license for more details": "GplDetails",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by 4 0": "CcBy",
    "licensed under cc by sa 4 0": "CcBySa",
    "licensed under cc by nc 4 0": "CcByNc",
    "licensed under cc by nc nd 4 0": "CcByNcNd",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy",
}
# Licences and their sequences of identifiers, longer sequences first; what a rule takes, no later one sees.
RULES = [
    ("GPL-3.0-or-later", ["GplGrant3Later", "GplNoWarranty", "GplDetails", "GplReceived"]),
    ("GPL-2.0-or-later", ["GplGrant2Later", "GplNoWarranty", "GplDetails", "GplReceived"]),
    ("Apache-2.0", ["ApacheNotice2", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("GPL-3.0-or-later", ["GplGrant3Later"]),
    ("GPL-2.0-or-later", ["GplGrant2Later"]),
    ("Apache-2.0", ["ApacheNotice2"]),
    ("Apache-2.0", ["ApacheRef2"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitRef"]),
    ("GPL-3.0", ["GplRef3"]),
    ("GPL-2.0", ["GplRef2"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd"]),
    ("Proprietary", ["AllRights"]),
]
UNKNOWN = "-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WRAPPED = r"\r?\n[ \t*#/%;-]*([a-z])"               # a line that goes on in small letters
SENTENCE_END = r"[.?]+[^A-Za-z0-9\s]*\s+|[\r\n]+"
NOT_WORD = "[^a-z0-9]+"
MARKS = r"[ \t*#/%;-]*+"                            # indents and comment marks before a line
# An empty line, unless an address follows, and the line before a list number.
PARAGRAPH = rf"\r?\n{MARKS}\r?\n(?:{MARKS}\r?\n)*+{MARKS}(?!https?://)|\r?\n(?={MARKS}\(?[0-9]{{1,2}}[.)]\s)"
LONG_END = r"[.?]+[^A-Za-z0-9\s]*\s+|\x00"          # lines are no ends here
HEADINGS = 3                                        # lines without a full stop, such as a title, that may stand before a wrapped sentence
NUMBER = "#"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the sentences in their order; other sentences are ``-``, those that are only a list number ``#``.

    A sentence may go on over any lines of its paragraph, whatever their first letters are, if it is then a known one;
    up to ``HEADINGS`` lines may stand before it. All else is taken apart by lines, unless they go on in small letters.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), NOT_WORD, " "))     # noqa: E731
    found = lambda s: F.coalesce(F.element_at(known, plain(s)), F.element_at(known, F.regexp_replace(plain(s), "^[0-9]{1,2} ", "")))

    def by_lines(s):
        lines = F.filter(F.split(F.regexp_replace(s, WRAPPED, " $1"), r"[\r\n]+", -1), lambda x: plain(x) != "")
        return F.transform(lines, lambda x: F.coalesce(found(x), F.when(F.regexp_like(plain(x), F.lit("^[0-9]{1,2}$")), F.lit(NUMBER)), F.lit(UNKNOWN)))

    def ids(s):
        out = by_lines(s)
        for n in range(HEADINGS, 0, -1):
            head, rest = F.regexp_extract(s, rf"^((?:[^\n]*\n){{{n}}})", 1), F.regexp_replace(s, rf"^(?:[^\n]*\n){{{n}}}", "")
            out = F.when((head != "") & found(rest).isNotNull(), F.concat(by_lines(head), F.array(found(rest)))).otherwise(out)
        return F.when(found(s).isNotNull(), F.array(found(s))).when(F.contains(s, F.lit("\n")), out).otherwise(by_lines(s))

    parts = F.split(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(" ")), PARAGRAPH, "\x00"), LONG_END, -1)
    return F.flatten(F.transform(F.filter(parts, lambda s: plain(s) != ""), ids))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_sentences``, ``n_known``, ``sequence``, ``licenses`` (in the order of the rules) and ``n_left``.

    ``sequence`` writes identifiers as ``<id>``, with ``<->`` for a stretch of other sentences. The rules are tried in
    their order; each takes all its occurrences, so a long rule wins over its parts. ``n_left`` counts known sentences
    that no rule took. List numbers count as sentences and part no known ones. Missing and empty texts have no sentences and no licence; repeated rows get equal results;
    input columns named like the result are replaced.
    """
    ids = df.drop("n_sentences", "n_known", "sequence", "licenses", "n_left").withColumn("_ids", sentence_ids(F.col(f"`{text}`")))
    wrapped = F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    out = (ids.withColumn("n_sentences", F.size("_ids").cast("long"))
           .withColumn("n_known", F.size(F.filter("_ids", lambda i: ~i.isin(UNKNOWN, NUMBER))).cast("long"))
           .withColumn("sequence", F.regexp_replace(F.replace(F.regexp_replace(
               wrapped, f"(?<=[A-Za-z0-9]>)(<{NUMBER}>)+(?=<[A-Z])", ""), F.lit(f"<{NUMBER}>"), F.lit("<->")), "(<->)+", "<->")).withColumn("_rest", F.col("sequence")))
    found = []
    for i, (name, rule) in enumerate(RULES):
        pattern = "".join(f"<{s}>" for s in rule)
        out = out.withColumn(f"_hit{i}", F.contains("_rest", F.lit(pattern))).withColumn("_rest", F.replace("_rest", F.lit(pattern), F.lit("<->")))
        found.append(F.when(F.col(f"_hit{i}"), F.lit(name)))
    left = F.length(F.regexp_replace(F.replace("_rest", F.lit("<->"), F.lit("")), "[^<]", "")).cast("long")
    return (out.withColumn("licenses", F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ","))
            .withColumn("n_left", left).drop("_ids", "_rest", *[f"_hit{i}" for i in range(len(RULES))]))


def op1_sentence_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs).drop("text")


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    steps, rest, hits = [], "sequence", []
    for i, (name, rule) in enumerate(RULES):
        pattern = "".join(f"<{s}>" for s in rule)
        hits.append(f"CASE WHEN contains(r{i}, '{pattern}') THEN '{name}' END")
        steps.append(f"s{i} AS (SELECT *, {rest} AS r{i}, replace({rest}, '{pattern}', '<->') AS q{i} FROM {f's{i - 1}' if i else 'seq'})")
        rest = f"q{i}"
    return rf"""WITH plain AS (SELECT doc_id, list_filter(list_transform(
    string_split_regex(regexp_replace(coalesce(text, ''), '{WRAPPED}', ' \1', 'g'), '{SENTENCE_END}'),
    lambda s: trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{NOT_WORD}', ' ', 'g'))), lambda s: s <> '') AS p FROM documents),
ids AS (SELECT doc_id, list_transform(p, lambda s: coalesce({known}[s], '{UNKNOWN}')) AS ids FROM plain),
seq AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, len(list_filter(ids, lambda i: i <> '{UNKNOWN}'))::BIGINT AS n_known,
    regexp_replace(coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), ''), '(<->)+', '<->', 'g') AS sequence FROM ids),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sequence,
    coalesce(array_to_string(list_filter([{", ".join(f"CASE WHEN f[{i + 1}] IS NOT NULL AND NOT list_contains(f[1:{i}], f[{i + 1}]) THEN f[{i + 1}] END" for i in range(len(RULES)))}],
        lambda x: x IS NOT NULL), ','), '') AS licenses,
    len(regexp_replace(replace({rest}, '<->', ''), '[^<]', '', 'g'))::BIGINT AS n_left
FROM (SELECT *, [{", ".join(hits)}] AS f FROM s{len(RULES) - 1})"""


ORACLE = _oracle()
