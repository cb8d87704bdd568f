"""License scans by canonical digests of entire texts.

A text is made canonical: lower case, copyright lines out, everything but
ASCII letters and digits to single blanks, equivalent spellings to one.  The
SHA-256 digest of the whole canonical text is joined to the digests of known
licences, made by the same rules.  Texts that this doesn't find are looked up
once more without copyright lines that have a name first (``NAMED``).  Long
licences are known by that second digest alone (``REGISTERED``).

Null and empty texts have the digest of the empty text, which is no licence.
Repeated rows give repeated rows; of known licences with equal digests the
smallest name wins.  The known digests are broadcast if there are at most
``BROADCAST_ROWS`` of them, else joined by a shuffle of ids and digests.
Main path: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.llm.common import free_name, table

BROADCAST_ROWS = 100_000
#: A copyright line may begin with marks, as those of a comment.
COPYRIGHT = r"(^|\n)[^a-z0-9©(\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
#: In lower case: a copyright line with a name; what licences themselves say of copyright isn't one.
NAMED = r"(^|\n)[^a-z0-9©(\n]*copyright:?[ \t]+(?!(?:notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|and|or|in|on|of|to|is|as|for|this|that|if|protect\w*|rights?|status|acts?|treat\w*|materials?|works?|doctrines?|infring\w*|disclaimers?|permissions?)\b)[^\n]*"
#: Equivalent spellings, after blanks are single.
SPELLINGS = (
    ("licenc", "licens"), ("organis", "organiz"), ("authoris", "authoriz"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"),
    ("per cent", "percent"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"),
    ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("initialis", "initializ"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Entire texts of known licences; a title line is a variant of its own.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    # notices that stand for a licence when they are all there is
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: Digests of entire texts by the rules below, without lines of ``NAMED``; a second
#: one is of the text up to the end of its terms.
REGISTERED = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3-only", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
)


def canonical(text: str = "text", named: bool = True):
    """The canonical form of a whole text; without ``named``, lines of ``NAMED`` go too."""
    out = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), COPYRIGHT, "$1")
    out = F.trim(F.regexp_replace(out if named else F.regexp_replace(out, NAMED, "$1"), "[^a-z0-9]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def digests(known: DataFrame, named: bool = True) -> DataFrame:
    """``digest`` and ``license`` of known texts (``license``, ``text``)."""
    own = known.select("license", canonical(named=named).alias("c")).where("c <> '' and license is not null")
    return own.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"))


def lookup(documents: DataFrame, known: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """All columns of ``documents``, ``digest`` of the canonical text and ``license`` (null: unknown).

    ``registered`` are further ``license``, ``digest`` of texts without lines of ``NAMED``.
    """
    docs = documents.drop("digest", "license")
    loose, second = (free_name(c, [*docs.columns, "digest", "license"]) for c in ("loose_digest", "loose_license"))
    own = docs.select("*", F.sha2(canonical(), 256).alias("digest"))
    own = own.withColumn(loose, F.coalesce(F.when(F.lower("text").rlike(NAMED), F.sha2(canonical(named=False), 256)), F.col("digest")))
    every = digests(known).unionByName(digests(known, named=False))
    every = every if registered is None else every.unionByName(registered.select("digest", "license"))
    table_ = every.groupBy("digest").agg(F.min("license").alias("license"))
    small = table_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    table_ = F.broadcast(table_) if small else table_
    found = own.join(table_, "digest", "left").join(table_.withColumnsRenamed({"digest": loose, "license": second}), loose, "left")
    return found.select(*docs.columns, "digest", F.coalesce("license", second).alias("license"))


def _values(spark: SparkSession, rows: tuple[tuple[str, str], ...], columns: str) -> DataFrame:
    args = {f"v{i}_{j}": x for i, r in enumerate(rows) for j, x in enumerate(r)}
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'(:v{i}_0, :v{i}_1)' for i in range(len(rows)))} AS t({columns})", args)


def known_texts(spark: SparkSession) -> DataFrame:
    return _values(spark, KNOWN, "license, text")


def registered_digests(spark: SparkSession) -> DataFrame:
    return _values(spark, REGISTERED, "license, digest")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup(table(spark, sf_dir, "documents").select("doc_id", "text"), known_texts(spark), registered_digests(spark))
    return found.select("doc_id", "digest", "license")


def _canonical_sql(text: str) -> str:
    copyright_ = COPYRIGHT.replace("'", "''")
    out = f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{copyright_}', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for other, one in SPELLINGS:
        out = f"replace({out}, '{other}', '{one}')"
    return out


OP5_SQL = "WITH k(license, text) AS (VALUES {}), d AS (SELECT sha256({}) AS digest, min(license) AS license FROM k GROUP BY ALL HAVING min(license) IS NOT NULL), o AS (SELECT doc_id, sha256({}) AS digest FROM documents) SELECT doc_id, o.digest, d.license FROM o LEFT JOIN (SELECT digest, min(license) AS license FROM d GROUP BY digest) d ON d.digest = o.digest".format(
    ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN), _canonical_sql("text"), _canonical_sql("text")
)
