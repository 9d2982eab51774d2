"""Reading graphs, part files and boundaries from text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import check_format
from ..operators.rank import saved

COMMENT = r"^\s*[#%]"


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) that are neither blank nor comments."""
    return lines.where(~F.col("value").rlike(COMMENT) & F.col("value").rlike(r"\S"))


def parse_edgelist(lines: DataFrame) -> DataFrame:
    """`src dst …` per line: one directed entry; further words are ignored, lines without two numbers give none."""
    w = _words(F.col("value"))
    rows = data_lines(lines).select(F.try_element_at(w, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(w, F.lit(2)).try_cast("long").alias("dst"))
    return rows.where("src is not null and dst is not null")


def parse_adjlist(lines: DataFrame) -> DataFrame:
    """`v n1 n2 …` per line: an entry from v to each neighbour. A lone id and a line that starts with no number give none."""
    ids = F.transform(_words(F.col("value")), lambda x: x.try_cast("long"))
    rows = data_lines(lines).select(F.get(ids, 0).alias("src"), F.explode(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).alias("dst"))
    return rows.where("src is not null and dst is not null")


#: A folder of ordered text keeps the order and length of its files here; readers of plain files do not see the name.
MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "place long, file string, n_lines long"
#: Blocks of the i-th file of an ordered folder begin at i times this.
_FILE_STRIDE = 1 << 40


def file_order(name: Column) -> tuple[Column, Column]:
    """Sort keys of the files of one write: by the number of their task, then by name."""
    return F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name


def write_manifest(spark: SparkSession, path: str) -> None:
    """Counts the lines of the files of a folder and keeps them there in the order of the tasks that wrote them."""
    counts = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))
    place = F.row_number().over(W.orderBy(*file_order(F.col("file")))) - 1  # a row for each file
    counts.select(place.cast("long").alias("place"), "file", "n_lines").coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one ordered text (file, block, id, value): of a file, or of a folder whose manifest gives the order of its files.

    Files are split freely: a line's block is where its split begins, and ids ascend in a block. Several
    files without a manifest have no order and are an error, and so are files that the manifest does not
    know or that are gone.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    files = sorted(unquote(f.rsplit("/", 1)[-1]) for f in spark.read.text(path).inputFiles())
    if any(c in path for c in "*?{[") or not _exists(spark, f"{path}/{MANIFEST}"):
        if len(files) > 1:
            raise ValueError(f"{path} holds {len(files)} files and no {MANIFEST} that orders them")
        return lines.select(F.lit(path).alias("file"), "block", "id", "value")
    listed = spark.read.schema(_MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}")
    known = sorted(r["file"] for r in listed.collect())  # the driver keeps a list of the files anyway
    if not set(known) <= set(files) or set(files) - set(known) - set(_empty(spark, path, files, known)):
        raise ValueError(f"the files of {path} are not those of its {MANIFEST}")
    order = F.broadcast(listed.select(F.col("file").alias("name"), "place"))
    return lines.join(order, "name").select(F.lit(path).alias("file"), (F.col("place") * _FILE_STRIDE + F.col("block")).alias("block"), "id", "value")


def _empty(spark: SparkSession, path: str, files: list[str], known: list[str]) -> list[str]:
    """Files of a folder that hold nothing, of those that its manifest does not list."""
    rest = sorted(set(files) - set(known))
    held = {r["name"] for r in spark.read.text([f"{path}/{f}" for f in rest]).select(F.col("_metadata.file_name").alias("name")).distinct().collect()} if rest else set()
    return [f for f in rest if f not in held]


def text_lines(texts: DataFrame) -> DataFrame:
    """The lines of small texts (file, value) in the form of `file_lines`."""
    split = F.split(F.regexp_replace("value", r"\r?\n$", ""), "\r?\n")
    return texts.select("file", F.lit(0).cast("long").alias("block"), F.posexplode(split).alias("id", "value")).withColumn("id", F.col("id").cast("long"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a saved scan (file, block, id, …) with their place in the file.

    Ids ascend by one in a block, so a row's place follows from the least id of its block and the number
    of rows in the blocks before, and only a row for each split of the input is shuffled. Where rows of a
    block were left out, its rows are counted.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("__least"), F.max("id").alias("__most"), F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("file").orderBy("block"))
    whole = (F.col("__most") - F.col("__least") + 1 == F.col("__n")).alias("__whole")
    before = F.broadcast(blocks.select("file", "block", (upto - F.col("__n")).alias("__before"), "__least", whole))  # a row for each split, of which the driver keeps a list
    held = rows.join(before, ["file", "block"])
    even = held.where("__whole").withColumn(name, F.col("__before") + F.col("id") - F.col("__least"))
    odd = held.where("not __whole").withColumn(name, F.col("__before") + F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1)
    return even.unionByName(odd).drop("__before", "__least", "__whole")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines of METIS texts with their place (file, at, line, head). Lines before the first that is not blank, and comments, go before places are counted."""
    lines = saved(lines)
    first = lines.where(F.col("value").rlike(r"\S")).groupBy("file").agg(F.min(F.struct("block", "id", "value")).alias("first"))
    bare = F.regexp_replace("value", r"^\s*#", "")
    rows = lines.join(F.broadcast(first), "file")  # one row for each text
    here, start = F.struct("block", "id"), F.struct("first.block", "first.id")
    rows = rows.withColumn("head", (here == start) & bare.rlike(r"^\s*\d+(\s+\d+)*\s*$"))
    kept = rows.where((here >= start) & (F.col("head") | ~F.col("value").rlike(COMMENT))).drop("first")
    return _numbered(kept, "at").select("file", "at", F.when(F.col("head"), bare).otherwise(F.col("value")).alias("line"), "head")


def parse_metis(lines: DataFrame, header: bool = True, dedup: bool = False) -> DataFrame:
    """Header, then line i holds the neighbours of vertex i from 1. An empty line is a vertex without neighbours.

    The header may be prefixed with `#`; other lines that start with # or % are comments. `lines` are
    those of `file_lines` or `text_lines`.
    """
    rows = numbered_lines(lines)
    vertex = F.col("at") if header else F.col("at") + 1
    ids = F.transform(_words(F.col("line")), lambda x: x.try_cast("long"))
    out = rows.where(F.col("at") > 0 if header else F.lit(True)).select(vertex.cast("long").alias("src"), F.explode(ids).alias("dst")).where("dst is not null")
    return out.distinct() if dedup else out


def metis_header(lines: DataFrame) -> DataFrame:
    """(n, m) of the first line of each file."""
    w = _words(F.col("line"))
    return numbered_lines(lines).where("at = 0").select("file", F.try_element_at(w, F.lit(1)).try_cast("long").alias("n"), F.try_element_at(w, F.lit(2)).try_cast("long").alias("m"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every entry in both directions."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def read_graph(spark: SparkSession, path: str | list[str], fmt: str, both_ways: bool = False, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entries of all files of a folder (each file once; names that start with . or _ are not read).

    A METIS graph is a file or a folder with a manifest; of a list of paths each is a graph of its own,
    and their entries are put together. `parse` replaces the built-in parser: it turns lines (value) into
    entries (src, dst).
    """
    if parse is not None:
        edges = parse(spark.read.text(path))
    elif check_format(fmt) == "metis":
        edges = reduce(DataFrame.unionAll, [parse_metis(file_lines(spark, p)) for p in ([path] if isinstance(path, str) else path)])
    else:
        edges = (parse_edgelist if fmt == "edgelist" else parse_adjlist)(spark.read.text(path))
    return symmetrize(edges) if both_ways else edges


def check_metis(lines: DataFrame) -> DataFrame:
    """(file, n, m, n_sources, n_entries): what the header says, the number of vertices with neighbours, and the entries. Raises if the header is not theirs."""
    rows = numbered_lines(lines)
    words = F.when(F.col("line").rlike(r"\S"), F.size(_words(F.col("line")))).otherwise(F.lit(0))
    body = rows.where("at > 0").select("file", words.alias("k")).groupBy("file").agg(F.count_if(F.col("k") > 0).alias("n_sources"), F.sum("k").cast("long").alias("n_entries"))
    w = _words(F.col("line"))
    head = rows.where("at = 0").select("file", F.try_element_at(w, F.lit(1)).try_cast("long").alias("n"), F.try_element_at(w, F.lit(2)).try_cast("long").alias("m"))
    found = head.join(body, "file", "left").select("file", "n", "m", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_entries")])
    wrong = found.where("not (n <=> n_sources and m <=> n_entries div 2)").first()
    if wrong is not None:
        raise ValueError(f"the header of {wrong['file']} says {wrong['n']} vertices and {wrong['m']} edges, its lines {wrong['n_sources']} and {wrong['n_entries'] // 2}")
    return found


def _placed_words(lines: DataFrame) -> DataFrame:
    """All words of texts with their place from 0: (file, at, word)."""
    words = lines.where(F.col("value").rlike(r"\S")).select("file", "block", F.explode(_words(F.col("value"))).alias("word"))
    return _numbered(saved(words.withColumn("id", F.monotonically_increasing_id())), "at").select("file", "at", "word")


def pair_scan(lines: DataFrame) -> DataFrame:
    """Free format: numbers are read two by two, whatever the line breaks; repeated pairs once."""
    w = _placed_words(lines).select("file", F.floor(F.col("at") / 2).alias("pair"), (F.col("at") % 2).alias("side"), F.col("word").try_cast("long").alias("n"))
    rows = w.groupBy("file", "pair").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("src"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("dst"))
    return rows.where("src is not null and dst is not null").select("src", "dst").distinct()


PART_FORMATS = ("pairs", "list")


def read_parts(spark: SparkSession, path: str | list[str], fmt: str = "pairs") -> DataFrame:
    """An assignment (v, part) from part files.

    `pairs`: lines `v<TAB>part`, in any number of files. `list`: the i-th word is the part of vertex i,
    from 1, whatever the line breaks, and -1 is a vertex without a part; it is one ordered text (see
    `file_lines`). Words that are no numbers are an error.
    """
    if fmt not in PART_FORMATS:
        raise ValueError(f"part files are {' or '.join(PART_FORMATS)}, not {fmt!r}")
    if fmt == "pairs":
        w = _words(F.col("value"))
        return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.get(w, 0).cast("long").alias("v"), F.get(w, 1).cast("int").alias("part"))
    texts = [_placed_words(file_lines(spark, p)) for p in ([path] if isinstance(path, str) else path)]
    return reduce(DataFrame.unionAll, texts).select((F.col("at") + 1).alias("v"), F.col("word").cast("int").alias("part")).where("part >= 0")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Exclusive upper bounds, one per part in order: (part, lower, upper). A file has a number for each part, so it is small."""
    rows = _placed_words(file_lines(spark, path)).select("file", F.col("at").cast("int").alias("part"), F.col("word").cast("long").alias("upper"))
    return rows.select("part", F.coalesce(F.lag("upper").over(W.partitionBy("file").orderBy("part")), F.lit(0)).alias("lower"), "upper")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def capped_files(files: DataFrame, gib: float) -> DataFrame:
    """The shortest prefix, by name, whose sizes add up to more than `gib` GiB."""
    before = F.coalesce(F.sum("bytes").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before).where(F.col("before") <= gib * 2**30).drop("before")


def count_lines(lines: DataFrame) -> DataFrame:
    """The number of lines that are no comments (blank ones count)."""
    return lines.where(~F.col("value").rlike(COMMENT)).agg(F.count(F.lit(1)).alias("n_lines"))
