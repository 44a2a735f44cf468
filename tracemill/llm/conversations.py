"""Conversation structure repair: faults of turns, and the cheapest edits that give a well-formed sequence of roles."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import kernels as K
from tracemill.llm import turn_grammar as G
from tracemill.llm.common import BROADCAST_ROWS, Scratch, read_table

#: Conversations with more rows or bytes of text are sorted and joined in several tasks.
LONG_ROWS, LONG_BYTES = 4096, 16 << 20
#: Rows of a long conversation whose codes travel as one string.
PIECE_BITS = 16
SPACES = " \t\n\x0b\f\r"
CODES = "ABCDEFGHIJKLMNOP"


class Repairs(NamedTuple):
    """``reports`` of every conversation, with the repaired turns unless it is long; ``long_turns`` (conv_id, place, step, role, text) of the long ones, if there are any."""

    reports: DataFrame
    long_turns: DataFrame | None


def _facts(rows: DataFrame) -> DataFrame:
    """Adds the key ``c`` (null ids are one conversation), the role's class, and whether a row is blank or truncated."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("c"), "turn", "role", "text",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("cls"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def _grouped(batches):
    """Tables of whole conversations from batches in which each conversation's rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = K.column(batch, "c").to_pylist()
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if held and keys[0] != K.column(held[-1], "c")[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
REPORT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(TURN)),
])
REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _written(actions: list[str], roles: list, texts: list) -> list[dict]:
    out = []
    for done, role, text in zip(actions, roles, texts):
        for x in done:
            if x in "ua":
                out.append({"role": "user" if x == "u" else "assistant", "text": ""})
            elif x != "D":
                out.append({"role": {"K": role, "U": "user", "A": "assistant"}[x], "text": text})
    return out


def _repair(batches):
    """Whole conversations to reports; a row without a role only says that there is such a conversation."""
    for table in _grouped(batches):
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        bounds = [0, *(i for i in range(1, table.num_rows) if column["c"][i] != column["c"][i - 1]), table.num_rows]
        spans, codes = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows = [i for i in range(a, b) if column["role"][i] is not None]
            seen, code = set(), []
            for i in rows:
                what = (column["role"][i], column["text"][i])
                fault = 1 if column["blank"][i] else 2 if what in seen else 3 if column["truncated"][i] else 0
                seen.add(what)
                code.append(column["cls"][i] + 4 * fault)
            spans.append((a, rows))
            codes.append(np.array(code, dtype=np.int64))
        out = []
        for (a, rows), code, found in zip(spans, codes, G.solve(codes)):
            turns = {column["turn"][i] for i in rows} - {None}
            edits, tail = found.pop("edits"), found.pop("tail")
            done = G.actions(code, edits, tail)
            out.append(found | {
                "conv_id": column["conv_id"][a], "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "audit": "".join(edits) + tail,
                "repaired": _written(done, [column["role"][i] for i in rows], [column["text"][i] for i in rows]),
            })
        yield pa.RecordBatch.from_pylist(out, schema=REPORT)


SOLVED = pa.schema([
    ("c", pa.string()), ("piece", pa.int64()), ("first", pa.int64()), ("actions", pa.list_(pa.string())),
    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
])


def _solve_pieces(batches):
    """Strings of row codes to what is to be done with each row, piece by piece, and the counts at each conversation's first piece."""
    for table in _grouped(batches):
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        bounds = [0, *(i for i in range(1, table.num_rows) if column["c"][i] != column["c"][i - 1]), table.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            code = np.frombuffer("".join(column["codes"][a:b]).encode(), np.uint8).astype(np.int64) - ord(CODES[0])
            found = G.solve([code])[0]
            edits, tail = found.pop("edits"), found.pop("tail")
            done, at = G.actions(code, edits, tail), 0
            for i in range(a, b):
                n = len(column["codes"][i])
                row = {"c": column["c"][i], "piece": column["piece"][i], "first": column["first"][i], "actions": done[at : at + n]}
                yield pa.RecordBatch.from_pylist([row | (found | {"audit": "".join(edits) + tail} if i == a else {})], schema=SOLVED)
                at += n


def _repair_long(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of long conversations, whose texts are never gathered.

    Rows are range-partitioned by conversation and turn, so that a conversation's rows are dealt to many tasks; which texts
    came earlier is an aggregate by role and text; a conversation then is one character a row, as long as the audit that it gives.
    """
    order = ["c", F.asc_nulls_first("turn"), "role", "text", "salt"]
    ordered = scratch.save(_facts(rows).withColumn("salt", F.rand(1)).orderBy(*order).drop("salt").withColumn("pos", F.monotonically_increasing_id()), "ordered")
    first = ordered.groupBy("c", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("truncated"), 3).otherwise(0)
    coded = ordered.select("c", "pos", "cls", "blank", "truncated").join(first, "pos", "left").select("c", "pos", F.substring(F.lit(CODES), F.col("cls") + 4 * fault + 1, F.lit(1)).alias("code"))
    pieces = coded.groupBy("c", F.shiftright("pos", PIECE_BITS).alias("piece")).agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    pieces = pieces.select("c", "piece", "first", F.array_join(F.transform("rows", lambda x: x["code"]), "").alias("codes"))
    ddl = "c string, piece long, first long, actions array<string>, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    solved = scratch.save(pieces.repartition("c").sortWithinPartitions("c", "piece").mapInArrow(_solve_pieces, ddl), "solved")
    spans = ordered.groupBy("c").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long")
    counts = solved.filter("cost is not null").drop("piece", "first", "actions")
    reports = counts.join(spans, "c").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lit(None).cast("array<struct<role:string,text:string>>").alias("repaired"))
    done = solved.select("first", F.posexplode("actions").alias("k", "done")).select((F.col("first") + F.col("k")).alias("pos"), "done")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    written = F.transform(F.split("done", ""), lambda x: F.when(x == "u", turn(F.lit("user"), F.lit(""))).when(x == "a", turn(F.lit("assistant"), F.lit(""))).when(x == "K", turn(F.col("role"), F.col("text"))).when(x == "U", turn(F.lit("user"), F.col("text"))).when(x == "A", turn(F.lit("assistant"), F.col("text"))))
    turns = ordered.join(done, "pos").select("conv_id", F.col("pos").alias("place"), F.posexplode(written).alias("step", "turn")).filter("turn is not null")
    return reports, turns.select("conv_id", "place", "step", "turn.role", "turn.text")


def repair_conversations(spark: SparkSession, conversations: DataFrame, known: DataFrame | None = None) -> Repairs:
    """Find faults of turns (conv_id, turn, role, text) and repair each conversation to roles ``(s?(ua)+)?`` at the least cost.

    Rows come by turn (nulls first), then role and text. The first fault of a row counts: blank (nothing but white space),
    duplicate (role and text seen earlier), truncated (last character that isn't white space not one of ``.!?``). Keeping a row
    costs 0, giving it the role user or assistant 2, deleting it 3 (blank and duplicate rows must go), inserting an empty
    turn anywhere 2; a truncated row that stays adds 1. Among the cheapest repairs the audit (D, I, K, R in order) is ASCII-least.

    Reports: conv_id, gaps (turns missing between the least and the largest), counts of blank, duplicate, truncated and illegal
    (neighbours whose roles' initials aren't su, ua or au), cost, audit, repaired turns.

    Roles count by their first character; an empty role fits nowhere. A null role or text is one space, null conv_ids are one
    conversation, null turns count for no gap. ``known`` (conv_id) adds conversations that may have no rows: zeros, no audit,
    no turns. Equal rows are duplicates of each other. Other columns are ignored. An empty table gives no rows.

    Short conversations meet in one task each, many to a batch. Those beyond ``LONG_ROWS`` rows or ``LONG_BYTES`` take the way
    of ``_repair_long``; there are few of them, so their keys may be broadcast.
    """
    scratch = Scratch(spark, "conversations")
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long_ids = scratch.save(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("long_id")), "long")
    n_long = long_ids.count()
    listed = F.broadcast(long_ids) if n_long <= BROADCAST_ROWS else long_ids
    facts = _facts(rows)
    if known is not None:
        empty = known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        facts = facts.unionByName(_facts(empty.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    if n_long:
        facts = facts.join(listed, is_long, "left_anti")
    short = facts.repartition("c").sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text").mapInArrow(_repair, REPORT_DDL)
    if not n_long:
        return Repairs(short, None)
    reports, turns = _repair_long(scratch, rows.join(listed, is_long, "left_semi"))
    return Repairs(short.unionByName(reports), turns)


def repaired_turns(repairs: Repairs) -> DataFrame:
    """The repaired conversations as rows: conv_id, place and step (to sort by), role, text."""
    short = repairs.reports.select("conv_id", F.posexplode("repaired").alias("place", "t")).select("conv_id", F.col("place").cast("long").alias("place"), F.lit(0).alias("step"), "t.role", "t.text")
    return short if repairs.long_turns is None else short.unionByName(repairs.long_turns)


def _hash_turns(batches):
    """SHA-256 of each conversation's lines, which come in order; a conversation may be longer than memory."""
    shape = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
    last, sha, ids = None, None, []
    for batch in batches:
        for c, role, text in zip(*(K.column(batch, x).to_pylist() for x in ("conv_id", "role", "text"))):
            if sha is None or c != last:
                if sha is not None:
                    ids.append({"conv_id": last, "sha": sha.hexdigest()})
                last, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
    if sha is not None:
        ids.append({"conv_id": last, "sha": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(ids, schema=shape)


def repaired_digests(repairs: Repairs) -> DataFrame:
    """Reports with ``repaired_sha256`` of the lines ``role:text`` instead of the turns.

    A hash takes its bytes one after the other: a long conversation's lines stream through one task, which keeps nothing of them.
    """
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    out = repairs.reports.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256))
    if repairs.long_turns is not None:
        hashed = repairs.long_turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").mapInArrow(_hash_turns, "conv_id long, sha string").withColumnRenamed("conv_id", "of")
        long = out.filter("repaired is null").join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256)))
        out = out.filter("repaired is not null").unionByName(long.select(*out.columns))
    return out.drop("repaired")


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's damage by crc32 of ``conv_id:turn`` (nulls: one space): what is left of the rows, and all conv_ids."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    left = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
    return left, conversations.select("conv_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on all damaged conversations; cases as in ``repair_conversations``."""
    left, ids = damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repaired_digests(repair_conversations(spark, left, ids))
