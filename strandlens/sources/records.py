"""Records of other shapes: repertoire tables, sequence and metadata pairs, structure atoms, lead tables, rule models."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Three-letter residue names, and header names of a lead table.
THREE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
LEAD_NAMES = {"lead": ["lead", "is_lead", "lead?", "lead_tf"], "id": ["seq id", "sequence id", "id", "name", "seqid"], "seq": ["aa sequence", "sequence", "aa", "protein sequence", "seq"]}


def read_repertoire(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """`names` (null where a file lacks one), source_file and metadata of repertoire tables below `path`: one line of JSON,
    a header, then rows; each file's separator is that of its header. Lines are told apart by what they hold, so that a
    large file can be read in parts; a header is a line that has "sequence" as one of its names."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    kind = F.when(F.col("value").startswith("{"), "metadata").when(F.col("value").rlike(r"^([^,;\t]*[,;\t])*sequence([,;\t]|$)"), "header").otherwise("row")
    lines = lines.filter(F.trim("value") != "").withColumn("kind", kind)
    heads = lines.filter("kind = 'header'").groupBy("source_file").agg(F.min("value").alias("head"))
    separator = F.when(F.col("head").contains("\t"), "\t").when(F.col("head").contains(";"), ";").otherwise(",")
    heads = heads.select("source_file", separator.alias("sep"), F.split("head", separator).alias("names"))
    meta = lines.filter("kind = 'metadata'").groupBy("source_file").agg(F.min("value").alias("metadata"))
    rows = lines.filter("kind = 'row'").join(heads, "source_file").join(meta, "source_file", "left")  # a row a file
    cell = lambda name: F.get(F.split("value", F.col("sep")), (F.array_position("names", F.lit(name)) - 1).cast("int"))
    return rows.select(*[F.when(F.array_contains("names", name), F.nullif(cell(name), F.lit(""))).alias(name) for name in names], "source_file", "metadata")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """id and seq of text lines `ID<sep>SEQ`, whatever the separator (comma, semicolon, tab, bar, colon or spaces); other
    lines go."""
    form = r"^\s*([^,;\t|: ]+)\s*[,;\t|: ]\s*([A-Za-z-]+)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(form))
    return lines.select(F.regexp_extract("value", form, 1).alias("id"), F.upper(F.regexp_extract("value", form, 2)).alias("seq"))


def read_pairs(spark: SparkSession, sequences: str, metadata: str, source: str, renamed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A tab-separated sequence table, whose `ids` are comma lists, with seq_id `<source>_<first id>`, and its metadata."""
    read = lambda path: spark.read.option("sep", "\t").option("header", True).csv(path)
    rows = read(sequences).withColumnsRenamed(renamed)
    return rows.withColumn("seq_id", F.concat(F.lit(f"{source}_"), F.trim(F.split("ids", ",")[0]))), read(metadata).withColumnsRenamed(renamed)


def atom_chains(lines: DataFrame, ident: str, line: str, chain: str) -> DataFrame:
    """`ident` and seq: the residues of one chain by number, from fixed-width ATOM lines (a cell may hold several); the first
    CA atom of a number counts. Lines are read in Arrow batches; those that lie together are shuffled as runs, not one by one."""
    kind = lines.schema[ident].dataType.simpleString()
    runs = lines.select(ident, F.col(line).alias("line")).mapInArrow(lambda batches: atom_runs(atoms_of(batches, ident, chain), ident), f"{ident} {kind}, number long, serial long, step long, letters string")
    held = runs.groupBy(ident).agg(F.collect_list(F.struct("number", "serial", "step", "letters")).alias("runs"))
    one = F.transform("runs", lambda r: F.transform(F.sequence(F.lit(0), F.length(r["letters"]) - 1), lambda i: F.struct((r["number"] + i).alias("number"), (r["serial"] + i * r["step"]).alias("serial"), F.substring(r["letters"], i + 1, F.lit(1)).alias("aa"))))
    atoms = F.when(F.size("runs") > 1, F.array_sort(F.flatten(one)))
    held = held.select(ident, "runs", F.explode(F.array(atoms)).alias("x"))
    first = F.filter("x", lambda r, i: (i == 0) | (F.get(F.col("x"), i - 1)["number"] != r["number"]))
    return held.select(ident, F.when(F.size("runs") == 1, F.col("runs")[0]["letters"]).otherwise(F.array_join(F.transform(first, lambda r: r["aa"]), "")).alias("seq"))


#: Letters of an ATOM line that are read, how "CA" can stand among the four of an atom's name, and cells read at a time.
READ, CA, CHAINS = 26, [b"CA  ", b" CA ", b"  CA"], 256


def cells(column: pa.Array) -> np.ndarray:
    """The first READ letters of each line, a row of bytes for each; spaces behind a line's end and for nulls."""
    raw = column.buffers()
    if len(column) and not column.null_count and raw[2] is not None:
        ends = np.frombuffer(raw[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        size = np.diff(ends)
        letters = np.frombuffer(raw[2], np.uint8)[ends[0] : ends[-1]]
        if size[0] >= READ and (size == size[0]).all() and not (letters >= 128).any():
            return letters.reshape(len(column), -1)[:, :READ]
    cut = b"".join((x or "")[:READ].ljust(READ).encode("latin-1", "replace") for x in column.to_pylist())
    return np.frombuffer(cut, np.uint8).reshape(len(column), READ)


def fields(lines: np.ndarray, a: int, b: int, value) -> np.ndarray:
    """`value` of each line's letters a to b (from 1), without the spaces around them; each different text is looked at once."""
    part = pa.Array.from_buffers(pa.binary(b - a + 1), len(lines), [None, pa.py_buffer(lines[:, a - 1 : b].tobytes())]).dictionary_encode()
    return np.array([value(x.decode("latin-1").strip(" ")) for x in part.dictionary.to_pylist()])[part.indices.to_numpy()]


def whole(missing: int):
    return lambda x: int(x) if re.fullmatch(r"[+-]?[0-9]+", x) else missing


def atoms_of(batches, ident: str, chain: str):
    """ident, number, serial and aa (a letter's code) of a chain's CA atoms, from batches of (ident, line); a cell may hold several lines."""
    four = lambda x: np.frombuffer(x, "<u4")[0]
    for batch in (b.slice(k, 1 << 14) for b in batches for k in range(0, b.num_rows, 1 << 14)):
        several = pc.any(pc.match_substring(batch.column("line"), "\n")).as_py()
        for start in range(0, batch.num_rows, CHAINS if several else 1 << 14):
            part = batch.slice(start, CHAINS) if several else batch
            column, ids = part.column("line"), part.column(ident)
            if several:
                split = pc.split_pattern(column, "\n")
                column, ids = split.flatten(), ids.take(pc.list_parent_indices(split))
            lines = cells(column)
            word = lambda a: np.ascontiguousarray(lines[:, a - 1 : a + 3]).view("<u4")[:, 0]
            name = word(13)
            own = np.flatnonzero((word(1) == four(b"ATOM")) & (lines[:, 21] == ord(chain)) & ((name == four(CA[0])) | (name == four(CA[1])) | (name == four(CA[2]))))
            if not len(own):
                continue
            lines = lines[own]
            # a missing number stands first, a missing serial last
            number, serial = fields(lines, 23, 26, whole(-MISSING)), fields(lines, 7, 11, whole(MISSING))
            letter = fields(lines, 18, 20, lambda x: ord(THREE.get(x, "X")))
            yield pa.record_batch([ids.take(pa.array(own)), pa.array(number, pa.int64()), pa.array(serial, pa.int64()), pa.array(letter, pa.uint8())], names=[ident, "number", "serial", "aa"])


def atom_lines(rows: DataFrame, ident: str, sequence: str) -> DataFrame:
    """`ident` and line: each sequence as a structure's ATOM lines, all of them in one cell: N and CA atoms of chain H, and a second CA
    of every fifth number. Letters that are no residue have no atoms of their own; a structure without atoms is no row."""
    kind = rows.schema[ident].dataType.simpleString()
    letters = sorted(THREE.values())
    full = {v: k for k, v in THREE.items()}
    code = np.full(256, len(letters), np.int64)
    code[[ord(x) for x in letters]] = np.arange(len(letters))
    made: list[np.ndarray] = []

    def templates(size: int) -> np.ndarray:
        """The three lines of each place and letter, as bytes."""
        for i in range(len(made), size):
            line = lambda serial, atom, residue: f"ATOM  {str(serial)[:5]:>5} {' ' + atom:<4} {residue} H{str(i + 1)[:4]:>4}    \n"
            own = [line(i * 3 + 1, "N", full.get(x, "UNK")) + line(i * 3 + 2, "CA", full.get(x, "UNK")) + line(i * 3 + 3, "CA", "GLY") for x in [*letters, ""]]
            made.append(np.frombuffer("".join(own).encode(), np.uint8).reshape(len(own), 3, -1))
        return np.stack(made)

    def write(batches):
        table = templates(1)
        for batch in batches:
            for start in range(0, batch.num_rows, CHAINS):
                part = batch.slice(start, CHAINS)
                texts = part.column("seq").fill_null("").to_pylist()
                size = max(map(len, texts), default=0)
                if not size:
                    continue
                table = table if len(table) >= size else templates(size)
                c = code[np.frombuffer("".join(x.ljust(size) for x in texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), size)]
                there = np.arange(size) < np.array([len(x) for x in texts])[:, None]
                held = np.stack([there & (c < len(letters)), there & (c < len(letters)), there & (np.arange(size) % 5 == 0)], axis=2)
                lines = table[np.arange(size), c][held]
                n = held.sum(axis=(1, 2))
                some = np.flatnonzero(n)
                # a line's end behind each but a cell's last
                ends, raw, wide = np.cumsum(n), lines.tobytes(), lines.shape[1]
                text = [raw[(b - k) * wide : b * wide - 1].decode() for b, k in zip(ends[some].tolist(), n[some].tolist())]
                yield pa.record_batch([part.column(ident).take(pa.array(some)), pa.array(text, pa.string())], names=[ident, "line"])

    return rows.select(ident, F.col(sequence).alias("seq")).mapInArrow(write, f"{ident} {kind}, line string")


#: Stands for a number or serial that isn't one; fields of a line hold five digits at most.
MISSING = 1_000_000_000


def atom_runs(batches, ident: str):
    """Atoms (ident, number, serial, a letter's code) of each Arrow batch as runs: successive numbers of one chain whose serials have one step,
    with their letters. Of a number's atoms in a batch only the first is kept. Lines of a chain that lie together become a row or two."""
    for batch in batches:
        if not batch.num_rows:
            continue
        number, serial = (batch.column(k).to_numpy() for k in ("number", "serial"))
        chain = batch.column(ident).dictionary_encode().indices.fill_null(-1).to_numpy()
        up = lambda x, rest: (x[1:] > x[:-1]) | ((x[1:] == x[:-1]) & rest)
        order = np.arange(len(chain)) if up(chain, up(number, serial[1:] >= serial[:-1])).all() else np.lexsort((serial, number, chain))
        c, n = chain[order], number[order]
        order = order[np.concatenate([[True], (c[1:] != c[:-1]) | (n[1:] != n[:-1])])]
        c, n, s = chain[order], number[order], serial[order]
        step = np.diff(s, prepend=s[0])
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (n[1:] != n[:-1] + 1)])
        # a run's own first step is free: its start's is that of the line before
        new |= np.concatenate([[False], ~new[:-1] & (step[1:] != step[:-1])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(n))
        letters = batch.column("aa").to_numpy()[order].tobytes().decode()
        steps = np.where(ends - starts > 1, step[np.minimum(starts + 1, len(n) - 1)], 0)
        yield pa.record_batch([batch.column(ident).take(pa.array(order[starts])), pa.array(n[starts]), pa.array(s[starts]), pa.array(steps), pa.array([letters[a:b] for a, b in zip(starts, ends)])], names=[ident, "number", "serial", "step", "letters"])


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "t", "true", "y", "yes"), F.lit(False))


def sanitized(x: Column) -> Column:
    """An id of letters, digits, dots and dashes; all else becomes one underscore."""
    return F.regexp_replace(F.trim(x), "[^A-Za-z0-9.-]+", "_")


def read_leads(frame: DataFrame) -> DataFrame:
    """is_lead, id and seq of a lead table, whatever its column names' case, spaces and marks; rows without id or residues go."""
    plain = {re.sub(r"[^a-z]", "", c.lower()): c for c in reversed(frame.columns)}
    exact = {c.lower().strip(): c for c in reversed(frame.columns)}
    found = {}
    for what, names in LEAD_NAMES.items():
        found[what] = next((exact[n] for n in names if n in exact), None) or next((plain[m] for n in names if (m := re.sub(r"[^a-z]", "", n)) in plain), None)
        if not found[what]:
            raise ValueError(f"no column like {names[0]!r} among {frame.columns}")
    column = lambda what: F.col(f"`{found[what]}`").cast("string")
    out = frame.select(truthy(column("lead")).alias("is_lead"), sanitized(column("id")).alias("id"), F.regexp_replace(F.upper(column("seq")), "[^A-Z]", "").alias("seq"))
    return out.filter((F.col("id") != "") & (F.col("seq") != ""))


def msa_id(prefix: Column, scaffold: Column, marks: Column, track: Column, mutations: Column, rank: Column, score: Column) -> Column:
    """`<prefix>_<Orig or Univ>_<hallmarks>_LEAD` without a track, else `..._T<track>R_<mutations>_r<rank>_s<score>`."""
    head = F.concat_ws("_", prefix, F.when(scaffold == "universal", "Univ").otherwise("Orig"), F.when(F.length(marks) == 4, marks).otherwise("XXXX"))
    ranked = F.concat_ws("_", head, F.concat(F.lit("T"), track.cast("string"), F.lit("R")), mutations, F.concat(F.lit("r"), F.lpad(rank.cast("string"), 3, "0")), F.concat(F.lit("s"), F.lpad(F.round(score * 1000).cast("int").cast("string"), 3, "0")))
    return F.when(track.isNull(), F.concat(head, F.lit("_LEAD"))).otherwise(ranked)


def dict_cells(cell: Column, names: list[str]) -> list[Column]:
    """Values of a printed dictionary such as {'cdr1': 'AC', 'cdr2': None}; missing ones are empty."""
    return [F.coalesce(F.nullif(F.regexp_extract(cell, rf"['\"]{n}['\"]\s*:\s*['\"]([^'\"]*)['\"]", 1), F.lit("")), F.lit("")).alias(n) for n in names]


def common_columns(frames: list[DataFrame], prefix: str = "imgt_") -> list[str]:
    """Position columns that all tables have, by number."""
    shared = set.intersection(*[{c for c in f.columns if c.startswith(prefix)} for f in frames])
    return sorted(shared, key=lambda c: int(c.removeprefix(prefix)))


def write_model(rules: DataFrame, path: str) -> None:
    """Rules as JSON lines, one for each family, condition and position, with their suggestions nested by rank."""
    suggestion = F.struct("rank", "aa", "support", "confidence", "lift")
    nested = rules.groupBy("family", "condition", "pos").agg(F.array_sort(F.collect_list(suggestion)).alias("suggestions"))
    nested.write.mode("overwrite").json(path)


MODEL = "family string, condition string, pos int, suggestions array<struct<rank: int, aa: string, support: bigint, confidence: double, lift: double>>"


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The rules of write_model(), a row for each suggestion."""
    found = spark.read.schema(MODEL).json(path)
    return found.select("family", "condition", "pos", F.explode("suggestions").alias("s")).select("family", "condition", "pos", "s.*")


def first_columns(frame: DataFrame) -> DataFrame:
    """Of columns by one name (as a union of tables may have) the first."""
    names = [f"c{i}" for i in range(len(frame.columns))]
    first = {}
    for name, c in zip(names, frame.columns):
        first.setdefault(c, name)
    return frame.toDF(*names).select(*[F.col(name).alias(c) for c, name in first.items()])


def capped_sample(rows: DataFrame, by: list[str], key: str, cap: int) -> DataFrame:
    """At most `cap` rows of each class, those of smallest hash."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= cap).drop("__place")
