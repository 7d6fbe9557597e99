"""Problem 2: generated, minified and vendored files and data saved as code."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log, log2

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut, table

# What headers and paths of files say that nobody on the project wrote.
GENERATED = re.compile(
    r"code generated by|^\W*@generated\b|auto-?\s?generated\s+(?:file|by|from|code by)\b|<auto-?generated|\bgenerated (?:automatically|by the \w+ (?:tool|compiler|generator))"
    r"|do not (?:edit|modify|change)(?: (?:this|it|manually|by hand|directly)|\W*$)|(?:edits|changes) (?:\w+ ){0,3}(?:will|may) be (?:overwritten|lost)|(?:machine|automatically)[- ](?:written|generated|made|produced) (?:from|by)"
    r"|is (?:auto-?)?(?:written|generated|produced|created|emitted) by the \S+|^\W*output of \S+ v?\d|instead of editing|this file (?:is|was) (?:auto-?|automatically )?(?:generated|produced|created|emitted)"
    r"|\bgeneriert (?:mit|von|durch)\b|automatisch erzeugt|nicht (?:bearbeiten|ändern|editieren)|\bfichier (?:produit|généré|créé) par\b|généré (?:automatiquement )?par\b|ne pas (?:modifier|éditer)|\b(?:archivo|fichero) (?:producido|creado|generado) por\b|\bgenerado (?:automáticamente )?(?:por|con)\b|no (?:editar|modificar)\b"
    r"|\barquivo (?:produzido|criado|gerado) por\b|\bgerado (?:automaticamente )?(?:por|com|pelo)\b|não (?:editar|edite|modificar|modifique|alterar|altere)|файл (?:создан|сгенерирован)|сгенерировано? |не (?:редактировать|редактируйте|изменять|править)", re.I | re.M)
NOT_SELF = re.compile(r"elsewhere|maintained by hand|written by hand|hand-?written|the order of", re.I)
COPIED = re.compile(r"unmodified copy|^\W*upstream:\s|licen[sc]ed under the|released under the [\w.\- ]+ licen[sc]e|^\W*(?:copyright\s*)?\(c\)\s*\d{4}|^\W*copyright\s+\d{4}|spdx-license-identifier|\bvendored from\b|^\W*(?:copied|taken|imported|adapted|bundled)(?: verbatim| unchanged| unmodified| as[- ]is)? from\b|\bverbatim (?:copy|from)\b|\bsend (?:patches|fixes|changes|bugs) (?:there|upstream)", re.I | re.M)
BANNER = re.compile(r"^\s*/\*[!*]?\s*[@\w./-]+\s+v?\d+(?:\.\d+)+[^\n]{0,60}\*/")
VENDOR_DIRS = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendors?|third[_-]?part(?:y|ies)|thirdparty|3rdparty|godeps|deps|externals?|jspm_packages|site-packages)/(?:[^/]+/)+[^/]+$", re.I)  # a copy has a folder of its own there; files right in such a folder are the project's
BUILT_DIRS = re.compile(r"(?:^|/)(?:generated|__generated__|generated-sources|autogen|auto-generated|codegen|gen|dist)/", re.I)
BUILT_NAMES = re.compile(r"[._-]min\.\w+$|\.pb\.\w+$|_pb2(?:_grpc)?\.pyi?$|_pb\.\w+$|\.(?:g|gen|generated)\.\w+$|(?:^|/)zz_generated|OuterClass\.java$|_gen\.\w+$|_generated\.\w+$|\.designer\.\w+$")
CODE = re.compile(r"\.(?:py|pyi|js|mjs|cjs|jsx|ts|mts|cts|tsx|go|java|c|h|cc|cpp|hpp|cs|rb|php|rs|kt|scala|swift|css|sql|sh)$", re.I)

_HEADER = re.compile(r"\A(?:\s*(?:#[^\n]*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|'use strict';?|\"use strict\";?)|\s*package [\w.]+;?[ \t]*(?=\n))*")
_LITERAL = re.compile(
    r"(\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?m:^[ \t]*#[^\n]*))|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_TOKEN = re.compile(r"[^\W\d]\w*|0[xX][\da-fA-F]+|\d[\d._]*\w*|[^\w\s]")
_WORDS = re.compile(r"[^\W\d_]\w*")
FEATURES = ("ratio", "entropy", "distinct", "ident_len", "short_ident", "comment", "line_len", "long_line", "numbers", "strings", "prose", "shapes", "ops", "named", "size", "listed")
LABELLED = 20_000  # labelled files at most that the forest is fitted on; every file is scored
TREES, DEPTH, LEAF, LIMIT = 48, 12, 1, 0.75
FIRST_TREES, FIRST_DEPTH, FIRST_LEAF, DOUBT = 12, 4, 12, 0.08  # of the first forest, which only sets aside unmarked files that look marked


def header(text: str) -> str:
    """The comments before the first line of code, package clauses aside."""
    return _HEADER.match(text)[0]


def notice(path: str, text: str) -> str | None:
    """generated, copied or minified as far as the header or the path says so; data for a file that is one literal."""
    text = text.replace("\r\n", "\n")
    if VENDOR_DIRS.search(path):
        return "copied"
    if not CODE.search(path):
        return None
    head = header(text)
    if any(GENERATED.search(line) and not NOT_SELF.search(line) for line in head.split("\n")):
        return "generated"
    if COPIED.search(head):
        return "copied"
    if BANNER.match(text):
        return "minified"
    if BUILT_DIRS.search(path) or BUILT_NAMES.search(path):
        return "built"
    return None


def features(text: str, listed: int | None) -> list[float]:
    """FEATURES of a whole text without its header, which names the labels."""
    text = text.replace("\r\n", "\n")
    text = text[len(header(text)) :]
    size = max(1, len(text))
    parts = [(m[0], m[1]) for m in _LITERAL.finditer(text)]
    comment = sum(len(whole) for whole, said in parts if said) / size
    literals = [whole for whole, said in parts if not said]
    in_strings = sum(map(len, literals))
    words_in = sum(len(w) for x in literals for w in _WORDS.findall(x) if w.islower() or w.istitle())
    bare = _LITERAL.sub(lambda m: " " if m[1] else "''", text)
    tokens = _TOKEN.findall(bare)
    n = max(1, len(tokens))
    counts = Counter(tokens)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    idents = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    numbers = sum(t[0].isdigit() for t in tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    shapes = Counter(re.sub(r"\w+", "a", re.sub(r"[\"'][^\"']*[\"']", "s", x)).strip() for x in lines)
    k = max(1, len(lines))
    longest = max(map(len, lines), default=0)
    raw = text.encode("utf-8", "surrogatepass")
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy, len(counts) / n, sum(map(len, idents)) / max(1, len(idents)), sum(len(t) <= 2 for t in idents) / max(1, len(idents)), comment,
        size / k, min(longest, 1_000) if comment < 0.5 and in_strings < 0.5 * size else 0.0, numbers / n, in_strings / size, words_in / max(1, in_strings), len(shapes) / k, len(tokens) / k,
        sum(map(len, idents)) / size, log(size), (listed or 0) / k,
    ]


def is_data(f: list[float]) -> bool:
    """Hardly anything but literals that aren't prose."""
    at = dict(zip(FEATURES, f))
    return at["named"] < 0.06 and at["comment"] < 0.3 and at["size"] > 5 and (at["strings"] < 0.5 or at["prose"] < 0.35)


def described(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, notice, FEATURES...): one row per file with a text; null paths count as empty, texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, notices, rows, codes = [], [], [], []
            for ident, path, listed, text in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(ident)
                said = notice(path or "", text)
                row = features(text, listed)
                codes.append(bool(CODE.search(path or "")))
                if said is None and codes[-1] and is_data(row):
                    said = "data"
                notices.append(said)
                rows.append(row)
            columns = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(notices, pa.string()), pa.array(codes, pa.bool_()), *(pa.array(c, pa.float64()) for c in columns)], names=["file_id", "notice", "code", *FEATURES])

    texts = contents.select(F.col("file_id").cast("bigint").alias("file_id"), "content").where("content is not null")
    both = files.select(F.col("id").cast("bigint").alias("file_id"), "path", F.col("line_count").cast("int").alias("line_count")).join(texts, "file_id")
    return both.select("file_id", "path", "line_count", "content").mapInArrow(run, "file_id bigint, notice string, code boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def not_handwritten(files: DataFrame, contents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(file_id, notice, score, handwritten): every file with a text; score is the forest's probability.

    Files that headers, paths or a body of mere literals mark as generated, minified or data are the
    positive labels, unmarked ones the negative. The forests see the body only, never the header or path. As marks are often missing, a first
    small forest sets unmarked files that look marked aside, and the second learns from the rest.
    The second forest's score alone decides on all of these, marked or not: handwritten is false from
    limit on. Copied files were written by hand, only elsewhere: no score can tell, so they train
    nothing and their notices and vendor folders decide. Files without text have no row; with one class
    missing every score is null and the marks decide.
    """
    rows = cut(described(files, contents))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vec", handleInvalid="keep")
    labelled = rows.where("code and (notice is null or notice <> 'copied')").withColumn("label", F.when(F.col("notice").isNull(), 0.0).otherwise(1.0))
    n, positives = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positives < n:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        share = min(1.0, LABELLED / n)
        train = cut(vectors.transform(labelled.where(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < share * 1_000_000)).select("vec", "label"))
        first = _forest(FIRST_TREES, FIRST_DEPTH, FIRST_LEAF).fit(train)
        sure = first.transform(train).where((F.col("label") > 0) | (vector_to_array("probability")[1] < DOUBT)).select("vec", "label")
        scored = _forest(TREES).fit(sure).transform(vectors.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    found = F.coalesce(F.col("notice") == "copied", F.lit(False)) | (F.col("code") & F.when(F.col("score").isNull(), F.col("notice").isNotNull()).otherwise(F.col("score") >= limit))
    return scored.select("file_id", "notice", "score", (~found).alias("handwritten"))


def _forest(trees: int, depth: int = DEPTH, leaf: int = LEAF) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vec", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=5, maxBins=64, subsamplingRate=0.8)


def _all(spark, d):
    return not_handwritten(table(spark, d, "files"), table(spark, d, "file_contents"))


def p2_found(spark, d):
    return _all(spark, d).where("not handwritten").select("file_id").distinct()


def p2_scores(spark, d):
    return _all(spark, d).select("file_id", "notice", F.round("score", 4).alias("score"), "handwritten")


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
SQL: dict[str, str] = {}
