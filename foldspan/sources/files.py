"""Files as tables. Each format has a parser over (file, text) rows, which any source of whole texts can feed, and a reader."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.functions.text import blank
from foldspan.operators.specs import spec_text
from foldspan.schemas import DESIGN_SPEC, THREAD
from foldspan.sources import spec_yaml


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def parse_fasta(files: DataFrame) -> DataFrame:
    """(file, rec_no, seq_id, sequence): lines trimmed and joined, blank ones skipped, headers without a body dropped; lines
    before the first header form a record without an id."""
    records = files.select("file", F.posexplode(F.split("text", "(?m)^[ \\t]*>")).alias("rec_no", "record"))
    return _record(records.select("file", "rec_no", (F.col("rec_no") > 0).alias("headed"), "record"))


def _record(records: DataFrame) -> DataFrame:
    """(file, rec_no, seq_id, sequence) of records (file, rec_no, headed, record)."""
    lines = records.select("file", "rec_no", "headed", F.transform(F.split("record", "\\r?\\n"), lambda x: F.trim(F.rtrim(x, F.lit("\r")))).alias("lines"))
    body = F.when(F.col("headed"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    found = lines.select("file", "rec_no", F.when(F.col("headed"), F.split_part(F.get("lines", 0), F.lit(" "), F.lit(1))).otherwise("").alias("seq_id"), F.array_join(body, "").alias("sequence"))
    return found.filter(F.col("sequence") != "")


def in_files(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, row, value): the parts of files between separators, with the start of the split that a part was read in
    and its order there. block and row order the parts of a file, however many tasks read it."""
    parts = spark.read.option("lineSep", separator).text(path)
    return parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_no, seq_id, sequence) by the rules of parse_fasta. Files are split at records, so that a file may be larger
    than a task's share and only a record is ever one row. rec_no rises in the order of a file, with gaps: a split's first
    byte plus the record's number in the split, which has more bytes than records."""
    parts = in_files(spark, path, "\n>")
    first = parts.groupBy("file", "block").agg(F.min("row").alias("first"))
    number = (F.col("block") + F.col("row") - F.col("first")) * (1 << 20)
    body = F.regexp_replace("value", "^[ \\t\\r\\n]*>", "")
    # the sign is the separator, but for what begins a file
    text = F.when((F.col("block") == 0) & (F.col("row") == F.col("first")) & (body == F.col("value")), F.col("value")).otherwise(F.concat(F.lit(">"), body))
    records = parts.join(first, ["file", "block"]).select("file", number.alias("number"), F.posexplode(F.split(text, "(?m)^[ \\t]*>")).alias("k", "record"))
    return _record(records.select("file", (F.col("number") + F.col("k")).alias("rec_no"), (F.col("k") > 0).alias("headed"), "record"))


def parse_tokens(lines: DataFrame, c: str = "value") -> DataFrame:
    """(token): the first token of each line that is not blank and no comment."""
    text = F.trim(F.regexp_replace(c, "\\t", " "))
    return lines.select("*", text.alias("__t")).filter((F.col("__t") != "") & ~F.col("__t").startswith("#")).withColumn("token", F.split("__t", "\\s+")[0]).drop("__t")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return parse_tokens(spark.read.text(path)).select("token")


def list_overrides(projects: DataFrame, lines: DataFrame, field: str) -> DataFrame:
    """projects with an array field replaced by the non-blank, trimmed lines (project_id, pos, value) given for it."""
    kept = lines.withColumn("value", F.trim("value")).filter("value <> ''")
    given = kept.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("__given"))
    return projects.join(given, "project_id", "left").withColumn(field, F.coalesce("__given", field)).drop("__given")


def read_table_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; of a repeated first name one copy stays, and a nameless first column goes. Types are
    those of schema, or inferred. A missing file raises."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    names, seen = [], set()
    for c in df.columns:
        base = c.rstrip("0123456789") if c.startswith("struct_name") else c
        if base in seen or c == "_c0":
            continue
        seen.add(base)
        names.append(F.col(f"`{c}`").alias(base))
    return df.select(*names)


_CHECKED = THREAD + ", _corrupt_record string"


def checked_threads(spark: SparkSession, path: str) -> DataFrame:
    """All thread files, one row each, in one scan: reason is null for a good one, else says what is wrong with it. Metadata
    stays JSON text."""
    rows = spark.read.schema(_CHECKED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return _with_reason(rows.withColumn("file", F.input_file_name()))


def _with_reason(rows: DataFrame) -> DataFrame:
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed JSON").when(F.coalesce(F.trim("thread_id"), F.lit("")) == "", "no thread_id").when(F.col("messages").isNull(), "no messages")
    return rows.select("*", reason.alias("reason"))


def parse_threads(files: DataFrame) -> DataFrame:
    """The rows of checked_threads out of (file, text): one for each text that is not blank. Metadata loses white
    space between its parts."""
    read = F.from_json("text", _CHECKED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return _with_reason(files.filter(F.trim(F.translate("text", "\t\r\n", "   ")) != "").select(read.alias("t"), "file").select("t.*", "file"))


def write_packed(files: DataFrame, path: str) -> None:
    """Files (file, text) as JSON lines of name and text, many in one part: parts grow with the bytes, not with the number of
    files, and a part can be split over tasks."""
    files.select(F.to_json(F.struct("file", "text")).alias("value")).write.text(path)


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files that write_packed has packed. A line that is no such pair raises."""
    return spark.read.schema("file string, text string").option("mode", "FAILFAST").json(path)


def good_threads(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").drop("_corrupt_record", "reason")


def quarantined(checked: DataFrame) -> DataFrame:
    """(file, reason, text) of the files that are no threads."""
    return checked.filter("reason is not null").select("file", "reason", F.col("_corrupt_record").alias("text"))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Thread files with their messages; malformed files are skipped, files without an id or messages are not."""
    return checked_threads(spark, path).filter("_corrupt_record is null").drop("_corrupt_record", "reason")


def numbered_models(lines: DataFrame) -> DataFrame:
    """lines (structure_id, line, value) with the model that each stands in: the MODEL records up to it, 1 before the first.
    line orders the lines of a structure; one structure's lines meet in one task, which its file format bounds."""
    begun = F.sum(F.col("value").startswith("MODEL ").cast("int")).over(Window.partitionBy("structure_id").orderBy("line"))
    return lines.withColumn("model", F.greatest(begun, F.lit(1)).cast("int"))


def parse_pdb(lines: DataFrame) -> DataFrame:
    """Atom rows of fixed-width ATOM and HETATM records (structure_id, value). Where lines has a column line, their order,
    models are numbered; else all atoms are those of model 1."""
    lines = numbered_models(lines) if "line" in lines.columns else lines.withColumn("model", F.lit(1))
    at = lambda a, n: F.trim(F.substring("value", a, n))
    num = lambda a, n: at(a, n).try_cast("double")
    atoms = lines.filter(F.col("value").rlike("^(ATOM  |HETATM)"))
    return atoms.select(
        "structure_id", "model", at(22, 1).alias("chain"), F.concat(at(23, 4), at(27, 1)).alias("resi"), at(18, 3).alias("resn"), at(13, 4).alias("atom_name"), at(17, 1).alias("alt"),
        at(77, 2).alias("element"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"), num(55, 6).alias("occupancy"), num(61, 6).alias("b"),
    )


def first_models(atoms: DataFrame) -> DataFrame:
    """The atoms that operators count: of each structure the first model, and of an atom in alternate locations the one with
    the highest occupancy, the first letter among equals."""
    first = atoms.groupBy("structure_id").agg(F.min("model").alias("model"))
    best = Window.partitionBy("structure_id", "chain", "resi", "resn", "atom_name").orderBy(F.desc_nulls_last("occupancy"), "alt")
    one = atoms.join(first, ["structure_id", "model"], "left_semi").filter("atom_name is not null")
    return one.withColumn("_best", F.row_number().over(best)).filter("_best = 1 OR alt = ''").drop("_best", "alt", "occupancy")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model of each PDB file, one location each. Lines keep their place in the file, so files may be
    split over tasks."""
    lines = structure_lines(spark, path)
    return first_models(parse_pdb(lines.filter(F.col("value").rlike("^(ATOM  |HETATM|MODEL )"))))


def cif_to_atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of the _atom_site loop of mmCIF lines (structure_id, line, value), where line orders a structure's lines.
    Column names are matched by position; values may be quoted; '.' and '?' are missing.

    Where the loop's names stand and where it ends is found from the few lines that begin with a name, a sign or a new loop;
    atoms are read line by line, so that a file may be split over tasks and is never one row."""
    text = F.trim(F.rtrim("value", F.lit("\r")))
    trimmed = lines.select("structure_id", "line", text.alias("row")).filter("row <> ''")
    named, ended = F.col("row").startswith("_atom_site."), F.col("row").startswith("#") | F.col("row").startswith("loop_") | F.col("row").startswith("data_")
    name = F.substr(F.split("row", "\\s+")[0], F.lit(len("_atom_site.") + 1))
    marks = trimmed.filter(named | ended).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.when(named, F.struct("line", name.alias("name"))))).alias("named"), F.array_sort(F.collect_list(F.when(ended, F.col("line")))).alias("ends"))
    marks = marks.filter(F.size("named") > 0).select("structure_id", F.transform("named", lambda x: x["name"]).alias("names"), F.element_at("named", -1)["line"].alias("last"), "ends")
    marks = marks.select("structure_id", "names", "last", F.get(F.filter("ends", lambda e: e > F.col("last")), 0).alias("end"))
    rows = trimmed.join(marks, "structure_id").filter((F.col("line") > F.col("last")) & (F.col("end").isNull() | (F.col("line") < F.col("end"))))
    cells = rows.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit("('(?:[^']|'(?=\\S))*'|\"[^\"]*\"|\\S+)"), F.lit(1)), lambda v: F.regexp_replace(v, "^(['\"])(.*)\\1$", "$2")))

    def cell(*options: str) -> Column:
        values = [F.get("cells", F.array_position("names", n).cast("int") - 1) for n in options]
        return F.coalesce(*(F.when(~v.isin(".", "?"), v) for v in values))

    return cells.select(
        "structure_id", F.coalesce(cell("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"), cell("auth_asym_id", "label_asym_id").alias("chain"),
        F.concat(blank(cell("auth_seq_id", "label_seq_id")), blank(cell("pdbx_PDB_ins_code"))).alias("resi"), cell("auth_comp_id", "label_comp_id").alias("resn"), cell("auth_atom_id", "label_atom_id").alias("atom_name"), blank(cell("label_alt_id")).alias("alt"),
        cell("type_symbol").alias("element"), *(cell(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"), cell("occupancy").try_cast("double").alias("occupancy"), cell("B_iso_or_equiv").try_cast("double").alias("b"),
    )


def structure_lines(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, line, value): the lines of structure files, with their place in the file."""
    return in_files(spark, path, "\n").select(F.col("file").alias("structure_id"), F.struct("block", "row").alias("line"), F.rtrim("value", F.lit("\r")).alias("value"))


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model of each mmCIF file, one location each."""
    return first_models(cif_to_atoms(structure_lines(spark, path)))


def yaml_to_json(files: DataFrame) -> DataFrame:
    """(file, text, problem) of spec texts (file, text), YAML as JSON; JSON texts stay. A text that cannot be read has no text
    and says why in problem; the job goes on. A text of another kind than a mapping raises, as it is no spec at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, text in zip(f["file"], f["text"], strict=True):
                problem = None
                if text and not text.lstrip().startswith("{"):
                    try:
                        found = spec_yaml.load(text)
                    except ValueError as e:
                        found, problem = None, str(e)
                    if found is not None and not isinstance(found, dict):
                        raise ValueError(f"{file}: a design spec must be a mapping")
                    text = None if problem else json.dumps(found or {})
                out.append((file, text, problem))
            yield pd.DataFrame(out, columns=["file", "text", "problem"])

    return files.select("file", "text").mapInPandas(run, "file string, text string, problem string")


def parse_design_specs(files: DataFrame) -> DataFrame:
    """(spec_id, entities) of JSON specs (file, text); blank texts are empty specs."""
    return files.select(F.col("file").alias("spec_id"), F.from_json(spec_text("text"), DESIGN_SPEC).alias("s")).select("spec_id", "s.entities")


def checked_design_specs(files: DataFrame) -> DataFrame:
    """(spec_id, entities, problem) of JSON or YAML specs (file, text), from one pass; problem says why a text gives none."""
    read = yaml_to_json(files).select(F.col("file").alias("spec_id"), F.from_json(spec_text("text"), DESIGN_SPEC + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("s"), "problem")
    return read.select("spec_id", "s.entities", F.coalesce("problem", F.when(F.col("s._corrupt_record").isNotNull(), "malformed JSON")).alias("problem"))


def read_design_specs(spark: SparkSession, path: str) -> DataFrame:
    """(spec_id, entities, problem) of a folder of spec files."""
    return checked_design_specs(whole_files(spark, path))
