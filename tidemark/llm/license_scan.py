"""License statements by diagonal voting, in joins and groupings of k-gram hashes.

All rolling word k-gram hashes of a text meet the k-grams of the templates in a broadcast
hash join (the templates are a fixed table of this module or the caller, never corpus
data). A hit votes for the diagonal "place in the text minus place in the template"; a full
copy puts all its votes on one diagonal, an edited copy on a few neighbouring ones, which
are merged. The join compares the k-gram's words beside the hash, so a vote is a verified
match. In templates of several sentences, k-grams of function words alone don't vote.

Verification. Along a merged span the votes are chained: places in the text and in the
template both grow, and what was put in or left out is jumped over at a price. A chain
is accepted by the share of its template's k-grams that it holds, in that order; so words in
another order are no copy, and a chain ends where its template ends.

Null text is the empty text: no words, no spans. Repeated rows give the same result each. An empty table gives no rows.
A very long text is its own group: all votes of one text for one template meet in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_WORD, lower_ascii, python_tasks, row_key, words_of


@dataclass(frozen=True)
class Template:
    """``exact`` templates count only where every word stands; others from ``least`` of their k-grams on."""

    label: str
    text: str
    exact: bool = False


#: Phrases whose every place counts.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
#: Statements of well-known public licenses, and license texts (fixed values).
STATEMENTS = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
    ),
)
#: Words whose k-grams don't vote for long templates (fixed values).
FUNCTION_WORDS = frozenset("a an and any are as at be by for from if in is it may must no not of on or out that the this to will with without you".split())
#: Templates of more words are long.
LONG_TEMPLATE = 25


def _grams(words: Sequence[str], k: int) -> list[tuple[int, str]]:
    """Places and k-grams that vote."""
    out = [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
    return [(i, " ".join(g)) for i, g in out if len(words) <= LONG_TEMPLATE or not FUNCTION_WORDS.issuperset(g)]


#: What a chain pays, in votes, for a jump beyond ``shift``, and for each word of the text that it passes over in it.
JUMP, PASSED = 1.0, 0.1


def chains(votes: Sequence[tuple[int, int]], shift: int, least: int) -> list[tuple[int, int, int]]:
    """``(votes held, first place, last place)`` of disjoint chains of ``least`` votes or more, the best first.

    ``votes`` are (place in the text, place in the template). Along a chain both places grow.
    Steps within ``shift`` diagonals are free, longer ones cost JUMP and PASSED; a chain is worth its votes less
    these costs. Votes are taken by place in the text. A free step comes from the last fitting
    vote of one of the near diagonals, as worth grows along a diagonal; a jump from the best
    vote of all lower template places, held in a tree of prefix maxima. So v votes take v log v steps.
    """
    order = sorted(set(votes))
    worth, size, before = [1.0] * len(order), [1] * len(order), [-1] * len(order)
    last: dict[int, list[int]] = {}  # votes of a diagonal so far
    top = max((y for _, y in order), default=0) + 2
    tree = [(-1e18, -1)] * (top + 1)  # best worth, as if passed words were paid from place 0 on
    i = 0
    while i < len(order):
        x, first = order[i][0], i
        while i < len(order) and order[i][0] == x:
            y, best, at = order[i][1], 0.0, -1
            for d in range(x - y - shift, x - y + shift + 1):
                if own := last.get(d):
                    limit = min(x, y + d)  # places in the text below it are below y in the template too
                    j = len(own) - 1
                    while j >= 0 and order[own[j]][0] >= limit:
                        j -= 1
                    if j >= 0 and worth[own[j]] > best:
                        best, at = worth[own[j]], own[j]
            k, far = y, (-1e18, -1)
            while k > 0:
                far = max(far, tree[k])
                k &= k - 1
            if (jumped := far[0] - JUMP - PASSED * x) > best:
                best, at = jumped, far[1]
            if at >= 0:
                worth[i], size[i], before[i] = best + 1, size[at] + 1, at
            i += 1
        for n in range(first, i):  # seen only by later places
            y, entry = order[n][1], (worth[n] + PASSED * (x + 1), n)
            last.setdefault(x - y, []).append(n)
            k = y + 1
            while k <= top:
                if tree[k] < entry:
                    tree[k] = entry
                k += k & -k
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []  # sorted spans
    used = bytearray(len(order))
    for i in sorted(range(len(order)), key=lambda i: (-worth[i], order[i])):
        if size[i] < least or used[i]:
            continue
        chain, j = [], i
        while j >= 0 and not used[j]:
            chain.append(j)
            used[j] = 1
            j = before[j]
        lo, hi = order[chain[-1]][0], order[i][0]
        n = bisect.bisect_left(taken, (lo, hi))
        if len(chain) >= least and (n == 0 or taken[n - 1][1] < lo) and (n == len(taken) or taken[n][0] > hi):
            taken.insert(n, (lo, hi))
            out.append((len(chain), lo, hi))
    return out


def scan(docs: DataFrame, key: str, text: str = "text", templates: Sequence[Template] = PHRASES + STATEMENTS, k: int = 2, shift: int = 3, least: float = 0.7, jump: int = 60) -> DataFrame:
    """Spans ``(key, template, label, exact, first_word, last_word, coverage)`` of verified statements.

    ``first_word`` is the text place of the span's first word, ``last_word`` of its last.
    ``jump`` is how far neighbouring diagonals may lie apart to be merged, ``shift`` how far a chain moves between diagonals at no cost. Templates need
    ``k`` words at least; their number and length bound the broadcast table.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    split = [t.text.split() for t in templates]
    if short := [t.text for t, w in zip(templates, split) if len(w) < k]:
        raise ValueError(f"shorter than {k} words: {short}")
    rows = [(g, i, p) for i, w in enumerate(split) for p, g in _grams(w, k)]
    index = spark.createDataFrame(rows, "gram string, template int, at int").withColumn("hash", F.xxhash64("gram"))
    facts = spark.createDataFrame([(i, t.label, t.exact, len(_grams(w, k))) for i, (t, w) in enumerate(zip(templates, split))], "template int, label string, exact boolean, n_grams int")

    words = docs.select(F.col(key).alias("key"), words_of(lower_ascii(F.col(text)), NON_WORD).alias("w")).where(F.size("w") >= k)
    gram = lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])
    rolled = words.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - k), gram)).alias("place", "words")).withColumn("hash", F.xxhash64("words"))
    votes = rolled.join(F.broadcast(index), (rolled["hash"] == index["hash"]) & (rolled["words"] == index["gram"])).select("key", "template", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    # each row holds a diagonal's votes, at most a template's k-grams
    diagonals = votes.groupBy("key", "template", "diagonal").agg(F.collect_set("at").alias("ats")).join(F.broadcast(facts), "template")
    span = lambda lo, hi, coverage: [F.col("key"), F.col("template"), F.col("label"), F.col("exact"), lo.cast("long").alias("first_word"), (hi + k - 1).cast("long").alias("last_word"), coverage.alias("coverage")]
    whole = diagonals.where("exact and size(ats) = n_grams").select(*span(F.col("diagonal"), F.col("diagonal") + F.col("n_grams") - 1, F.lit(1.0)))

    near = Window.partitionBy("key", "template").orderBy("diagonal")
    loose = diagonals.where("not exact").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= jump, 0).otherwise(1))
    loose = loose.withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = loose.groupBy("key", "template", "span", "label", "exact", "n_grams").agg(F.collect_list(F.struct("diagonal", "ats")).alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"))

    @F.pandas_udf("array<struct<n:int,lo:int,hi:int>>")
    def verified(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, sizes in parts:
            yield pd.Series([[dict(zip(("n", "lo", "hi"), c)) for c in chains([(d["diagonal"] + a, a) for d in found for a in d["ats"]], shift, -int(-least * n // 1))] for found, n in zip(lists, sizes)], dtype=object)

    merged = merged.where(F.col("n") >= least * F.col("n_grams")).withColumn("c", F.explode(verified("votes", "n_grams")))
    return whole.unionByName(merged.select(*span(F.col("c.lo"), F.col("c.hi"), F.col("c.n") / F.col("n_grams"))))


def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row a document: ``n_words``, ``spans`` of all verified statements (array, by place)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    found = scan(own, "key", "text", **options).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "exact", "coverage"))).alias("spans"))
    heads = own.select("key", "doc_id", F.size(words_of(lower_ascii(F.col("text")), NON_WORD)).cast("long").alias("n_words"))
    return heads.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
