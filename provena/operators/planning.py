"""Content plans against template contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.findings import union_all
from provena.session import settle


def membership(plan_slots: DataFrame, slots: DataFrame, sections: DataFrame) -> DataFrame:
    """Plan sections and slots the contract lacks, and required slots the plan lacks."""
    version = "template_version_id"
    planned = plan_slots.select("task_id", version, "slot_id").distinct()
    unknown_slot = planned.join(slots.select(version, "slot_id"), [version, "slot_id"], "left_anti").select(
        "task_id", F.concat(F.lit("unknown slot: "), F.col("slot_id")).alias("violation")
    )
    named = plan_slots.select("task_id", version, "section_id").distinct()
    unknown_section = named.join(sections.select(version, "section_id"), [version, "section_id"], "left_anti").select(
        "task_id", F.concat(F.lit("unknown section: "), F.col("section_id")).alias("violation")
    )
    plans = plan_slots.select("task_id", version).distinct()
    required = plans.join(slots.filter("required").select(version, "slot_id"), version)
    absent = required.join(planned, ["task_id", "slot_id"], "left_anti").select(
        "task_id", F.concat(F.lit("required slot missing from plan: "), F.col("slot_id")).alias("violation")
    )
    return union_all([unknown_section, unknown_slot, absent])


def attribute_echo(plan_slots: DataFrame, slots: DataFrame) -> DataFrame:
    """Contract-owned attributes a plan changed. Slots outside the contract are skipped."""
    owned = slots.select(
        "template_version_id", "slot_id", F.col("kind").alias("_kind"),
        F.col("required").alias("_required"), F.col("style_key").alias("_style_key"),
    )
    joined = plan_slots.join(owned, ["template_version_id", "slot_id"])

    def changed(name: str):
        mine, theirs = F.col(name).cast("string"), F.col(f"_{name}").cast("string")
        text = F.concat(
            F.lit("slot "), F.col("slot_id"), F.lit(f" {name} mismatch: plan="), mine, F.lit(" contract="), theirs
        )
        return F.when(mine != theirs, text)

    found = F.array_compact(F.array(*[changed(n) for n in ("kind", "required", "style_key")]))
    return joined.select("task_id", F.explode(found).alias("violation"))


def unknown_dependencies(plan_slots: DataFrame) -> DataFrame:
    planned = plan_slots.select("task_id", F.col("slot_id").alias("dep")).distinct()
    wanted = plan_slots.select("task_id", "slot_id", F.explode("depends_on").alias("dep"))
    return wanted.join(planned, ["task_id", "dep"], "left_anti").select(
        "task_id",
        F.concat(F.lit("slot "), F.col("slot_id"), F.lit(" depends_on unknown slot: "), F.col("dep")).alias("violation"),
    )


def _dependencies(plan_slots: DataFrame) -> DataFrame:
    """One row (task_id, slot_id, root_pos, place, dep) per dependency on a slot of the plan.

    A slot named twice stands at its first position and has the dependencies of its last.
    """
    once = plan_slots.groupBy("task_id", "slot_id").agg(
        F.min("plan_pos").alias("root_pos"), F.max_by("depends_on", "plan_pos").alias("_deps")
    )
    wanted = once.select("task_id", "slot_id", "root_pos", F.posexplode("_deps").alias("place", "dep"))
    known = once.select("task_id", F.col("slot_id").alias("dep"))
    return wanted.join(known, ["task_id", "dep"], "left_semi")


def _reach_a_cycle(links: DataFrame) -> DataFrame:
    """The slots (task_id, slot_id) of (task_id, slot_id, dep) from which a cycle can be reached.

    Each round drops dependencies on slots that have none left, and lets a dependency on a
    slot with a single one jump to that one, so a chain shrinks to half a round. A round
    that drops nothing leaves only slots on the way to a cycle.
    """
    links = settle(links.distinct(), "plan-links")
    left = links.count()
    while left:
        onward = links.groupBy("task_id", F.col("slot_id").alias("dep")).agg(
            F.count("*").alias("_n"), F.min("dep").alias("_only")
        )
        target = F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("dep"))
        links = settle(
            links.join(onward, ["task_id", "dep"]).select("task_id", "slot_id", target.alias("dep")).distinct(), "plan-links"
        )
        before, left = left, links.count()
        if left == before:
            break
    return links.select("task_id", "slot_id").distinct()


def dependency_cycles(plan_slots: DataFrame) -> DataFrame:
    """The first dependency cycle of each plan, as ``a -> b -> a``; plans without one drop out.

    It is the cycle that following slots and dependencies in order meets first: of the slots
    that can reach a cycle the earliest one, and from each slot its first dependency that can
    reach one. The walk is doubled each round by joins on (plan, slot), with the step doubled
    too, so a plan of any size is spread over the cluster; only the slots of the cycle that is
    reported come together in a row. NULL dependencies count as none.
    """
    deps = settle(_dependencies(plan_slots), "plan-dependencies")
    open_ = settle(_reach_a_cycle(deps.select("task_id", "slot_id", "dep")), "plan-open")
    onward = deps.join(open_, ["task_id", "slot_id"], "left_semi").join(
        open_.withColumnRenamed("slot_id", "dep"), ["task_id", "dep"], "left_semi"
    )
    step = settle(
        onward.groupBy("task_id", "slot_id").agg(F.min_by("dep", "place").alias("_to"), F.min("root_pos").alias("root_pos")),
        "plan-steps",
    )
    begin = step.groupBy("task_id").agg(F.min_by("slot_id", "root_pos").alias("slot_id"), F.count("*").alias("_n"))
    walk = begin.withColumn("at", F.lit(0).cast("bigint"))
    longest = begin.agg(F.max("_n")).first()[0] or 0
    step, length = step.join(begin.select("task_id", "_n"), "task_id").drop("root_pos"), 1
    while length <= longest:
        # A plan is done once its walk has more steps than it has slots.
        step = step.filter(F.col("_n") >= length)
        ahead = walk.join(step.drop("_n"), ["task_id", "slot_id"]).select(
            "task_id", F.col("_to").alias("slot_id"), "_n", (F.col("at") + length).alias("at")
        )
        walk = settle(walk.unionByName(ahead), "plan-walk")
        length *= 2
        second = step.select("task_id", F.col("slot_id").alias("_to"), F.col("_to").alias("_next"))
        doubled = step.filter(F.col("_n") >= length).join(second, ["task_id", "_to"])
        step = settle(doubled.select("task_id", "slot_id", F.col("_next").alias("_to"), "_n"), "plan-steps")
    visits = walk.groupBy("task_id", "slot_id").agg(F.min("at").alias("at"), F.count("*").alias("_times"))
    entry = visits.filter(F.col("_times") > 1).groupBy("task_id").agg(F.min("at").alias("_from"))
    path = visits.join(entry, "task_id").filter(F.col("at") >= F.col("_from")).groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "slot_id"))), lambda v: v["slot_id"]).alias("_path")
    )
    return path.select("task_id", F.concat_ws(" -> ", "_path", F.get("_path", F.lit(0))).alias("cycle"))


def validate(plan_slots: DataFrame, slots: DataFrame, sections: DataFrame) -> DataFrame:
    """All violations of all plans."""
    cycles = dependency_cycles(plan_slots).select(
        "task_id", F.concat(F.lit("depends_on cycle: "), F.col("cycle")).alias("violation")
    )
    return union_all(
        [
            membership(plan_slots, slots, sections),
            attribute_echo(plan_slots, slots),
            unknown_dependencies(plan_slots),
            cycles,
        ]
    )


def coverage(sections: DataFrame, slots: DataFrame) -> DataFrame:
    """Sections naming unknown slots, and slots in no section."""
    version = "template_version_id"
    named = sections.select(version, "section_id", F.explode("slot_ids").alias("slot_id"))
    unknown = named.join(slots.select(version, "slot_id"), [version, "slot_id"], "left_anti").select(
        version, F.concat(F.lit("section "), F.col("section_id"), F.lit(" references unknown slot "), F.col("slot_id")).alias("problem")
    )
    orphan = slots.select(version, "slot_id").join(named, [version, "slot_id"], "left_anti").select(
        version, F.concat(F.lit("slot not covered by any section: "), F.col("slot_id")).alias("problem")
    )
    return unknown.unionByName(orphan)


def duplicates(rows: DataFrame, owner: str, kind: str, value: str) -> DataFrame:
    """Values an owner holds more than once."""
    return (
        rows.groupBy(owner, value)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(F.col(owner).alias("owner"), F.lit(kind).alias("kind"), F.col(value).alias("value"), "n")
    )
