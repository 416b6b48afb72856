"""States that follow from ordered events, staleness, verdicts, merging and connected groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpoint

# Fixed value: attempts after which a repair is given up.
MAX_ATTEMPTS = 3

EPISODE = "key string, state string, attempts int, recurrences int, superseded int, decision string"


def episode(reports: pd.DataFrame, cap: int = MAX_ATTEMPTS) -> tuple[str, int, int, int, str]:
    """Fold one key's reports, in order, into (state, attempts, recurrences, superseded, decision).

    A report has event, source, wording and kind (``report`` or ``absent``). The
    same event again is the same attempt; another source starts anew; absence
    closes; a report after closing recurs and keeps what was rejected before.
    """
    state, source, wordings, rejected, last = "", None, [], [], None
    recurrences = superseded = 0
    for row in reports.itertuples(index=False):
        if row.kind == "absent":
            state = "closed" if state == "open" else state
            continue
        if state and row.source != source:
            superseded, wordings, rejected, last = superseded + 1, [], [], None
            recurrences = 0
        elif state == "closed":
            superseded, recurrences = superseded + 1, recurrences + 1
            rejected, wordings, last = rejected + wordings, [], None
        source, state = row.source, "open"
        if row.event and row.event == last:
            continue
        last = row.event
        wordings.append(row.wording)
    decision = ""
    if state == "open":
        if len(wordings) > 1 and wordings[-1] == wordings[-2]:
            decision = "no-new-evidence"
        elif wordings and wordings[-1] in set(rejected) | set(wordings[:-1]):
            decision = "oscillating"
        elif len(wordings) >= cap:
            decision = "rounds-exhausted"
    return state, len(wordings), recurrences, superseded, decision


def repair_episodes(reports: DataFrame) -> DataFrame:
    """The episode of every key of ``reports`` (key, at, event, source, wording, kind); an episode is one unit's short history."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows.key.iloc[0], *episode(rows.sort_values(["at", "event"])))], columns=[c.split()[0] for c in EPISODE.split(", ")])

    return reports.where("key is not null").groupBy("key").applyInPandas(fold, EPISODE)


def page_states(events: DataFrame) -> DataFrame:
    """(key, state, attempts): the last state of a page; attempts count failures since its source or translation last moved.

    ``events`` has key, at, state, source_hash, target_hash. Without a fold: the
    last row at which a hash moved opens the stretch that counts.
    """
    order = Window.partitionBy("key").orderBy("at", "state")
    moved = ~F.col("source_hash").eqNullSafe(F.lag("source_hash").over(order)) | ~F.col("target_hash").eqNullSafe(F.lag("target_hash").over(order))
    stretch = F.sum(F.when(moved, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = events.withColumn("stretch", stretch)
    per = marked.groupBy("key", "stretch").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.count_if(F.col("state") == "failed").alias("attempts"))
    return per.groupBy("key").agg(F.max(F.struct("stretch", "state", "attempts")).alias("m")).select("key", "m.state", F.col("m.attempts").alias("attempts"))


def stale_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stage, moved): keys of inputs (stage, key, digest) that changed, went or came, in order."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, (F.col("o.stage") == F.col("n.stage")) & (F.col("o.key") == F.col("n.key")), "full")
    moved = joined.where(~F.col("o.digest").eqNullSafe(F.col("n.digest")))
    return moved.groupBy(F.coalesce("o.stage", "n.stage").alias("stage")).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("o.key", "n.key"))), ",").alias("moved"))


def review_verdict(reviewed: Column, recovering: Column, verified: Column, fresh: Column, rejected: Column) -> Column:
    """The first of these that holds: not-reviewed, recovery, unverified-digest, stale-review, rejected, ok."""
    return (
        F.when(~reviewed, "not-reviewed").when(recovering, "recovery").when(~verified, "unverified-digest")
        .when(~fresh, "stale-review").when(rejected, "rejected").otherwise("ok")
    )


def events_once(events: DataFrame, identity: list[str]) -> DataFrame:
    """A replayed event is the event it repeats."""
    return events.dropDuplicates(identity)


def merged_replies(units: DataFrame, replies: DataFrame) -> DataFrame:
    """Units with the target that a reply gives them, all or nothing per book.

    ``replies`` has book_id, id, target. A book's replies are applied only if each
    names a unit of the book, none twice with different targets and none is blank;
    otherwise its units stay as they are. ``merged`` tells which.
    """
    known = replies.join(units.select("book_id", "id").withColumn("known", F.lit(True)), ["book_id", "id"], "left")
    blank = F.coalesce(F.trim("target"), F.lit("")) == ""
    per_unit = known.groupBy("book_id", "id").agg(F.max("target").alias("answer"), F.countDistinct("target").alias("n"), F.max(blank).alias("blank"), F.max(F.col("known").isNull()).alias("foreign"))
    refused = per_unit.groupBy("book_id").agg(F.max((F.col("n") > 1) | F.col("blank") | F.col("foreign")).alias("refused"))
    joined = units.join(per_unit.select("book_id", "id", "answer"), ["book_id", "id"], "left").join(refused, "book_id", "left")
    apply = ~F.coalesce("refused", F.lit(True)) & F.col("answer").isNotNull()
    return joined.withColumn("target", F.when(apply, F.col("answer")).otherwise(F.col("target"))).withColumn("merged", apply).drop("answer", "refused")


def superseded_replies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replies (id, token) whose request changed or is gone, with why."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.id") == F.col("n.id"), "left").where(~F.col("o.token").eqNullSafe(F.col("n.token")))
    return joined.select("o.id", F.when(F.col("n.id").isNull(), "gone").otherwise("changed").alias("why"))


def conflicting_edits(edits: DataFrame) -> DataFrame:
    """(id, n_wordings): units that edits (id, target) would set to different wordings."""
    return edits.groupBy("id").agg(F.countDistinct("target").alias("n_wordings")).where("n_wordings > 1")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected groups of an undirected graph (a, b), named by their least node.

    Alternating large-star and small-star steps keep every node near its
    component's least one, so a long chain needs about log steps and a hub with
    many neighbours is one key only in combinable minima; state is checkpointed.
    """
    both = edges.where("a is not null and b is not null")
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = checkpoint(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = -1
    while True:
        # large star: larger neighbours of a node point to its least neighbour (or itself)
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: smaller neighbours and the node itself point to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        starred = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y").distinct()
        links = checkpoint(starred.select(F.col("x").alias("a"), F.col("y").alias("b")))
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == total:
            break
        total = mark
    return nodes.join(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def parent_cycles(children: DataFrame) -> DataFrame:
    """(id): ids of (id, parent) that lie on a cycle of parents; of several parents the least counts.

    Pointers are doubled until the nodes they reach no longer become fewer: then
    each of these is reached from another of them, so all lie on cycles.
    """
    reach = checkpoint(children.where("id is not null and parent is not null").groupBy("id").agg(F.min("parent").alias("top")))
    tops = lambda: reach.select(F.col("top").alias("id")).distinct()
    before, now = -1, tops().count()
    while now != before:
        onward = reach.select(F.col("id").alias("top"), F.col("top").alias("next"))
        reach = checkpoint(reach.join(onward, "top").select("id", F.col("next").alias("top")))
        before, now = now, tops().count()
    return tops()


def grid_problems(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(table_id, at_row, at_column, problem): grid places taken twice, out of bounds or left free between taken ones."""
    span = lambda start, n: F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1))
    taken = cells.select("table_id", span("row", "row_span").alias("at_row"), "column", "column_span").select("table_id", "at_row", span("column", "column_span").alias("at_column"))
    counted = taken.groupBy("table_id", "at_row", "at_column").agg(F.count(F.lit(1)).alias("n"))
    bounds = counted.join(sizes.select("table_id", "rows", "columns"), "table_id")
    twice = counted.where("n > 1").select("table_id", "at_row", "at_column", F.lit("overlap").alias("problem"))
    outside = bounds.where("at_row >= rows or at_column >= columns").select("table_id", "at_row", "at_column", F.lit("out of bounds").alias("problem"))
    order = Window.partitionBy("table_id", "at_row").orderBy("at_column")
    ahead = counted.withColumn("next", F.lead("at_column").over(order)).where("next > at_column + 1")
    holes = ahead.select("table_id", "at_row", F.explode(F.sequence(F.col("at_column") + 1, F.col("next") - 1)).alias("at_column"), F.lit("hole").alias("problem"))
    return twice.unionByName(outside).unionByName(holes)


def answer_key(text: Column) -> Column:
    """An answer as it is compared: Persian yeh and kaf, one space for punctuation and white space, lower case."""
    persian = F.translate(text, "يك", "یک")
    return F.trim(F.regexp_replace(F.lower(persian), r"[\p{P}\s]+", " "))


def graded(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, axis, verdict): pass if the answer is an accepted one, fail if a failing one, else unknown.

    ``cases`` has id, axis, accepts and fails (arrays); ``answers`` has id, answer.
    """
    keys = lambda c: F.transform(c, lambda x: answer_key(x))
    joined = cases.join(answers, "id", "left").withColumn("key", answer_key(F.col("answer")))
    verdict = F.when(F.array_contains(keys("accepts"), F.col("key")), "pass").when(F.array_contains(keys("fails"), F.col("key")), "fail").otherwise("unknown")
    return joined.select("id", "axis", F.when(F.col("answer").isNull(), "unknown").otherwise(verdict).alias("verdict"))


def adjudicated(verdicts: DataFrame) -> DataFrame:
    """(id, status): disputed if judges both accept and reject, the verdict if one stands, else pending."""
    kinds = verdicts.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("verdict") != "unknown", F.col("verdict")))).alias("vs"))
    both = F.array_contains("vs", "accept") & F.array_contains("vs", "reject")
    return kinds.select("id", F.when(both, "disputed").when(F.size("vs") == 1, F.get("vs", F.lit(0))).otherwise("pending").alias("status"))
