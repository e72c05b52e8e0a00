"""Closure of expected against supplied rows, and lineage of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, at_or_below, path_valid, semver
from ..functions.unicode import folded
from ..model import FILE


def closure(expected: DataFrame, supplied: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, problem) of every key that is missing, unexpected, supplied more than once, or differs in its facts."""
    e = expected.select(F.col(key).alias("_e"), F.struct(*facts).alias("_ef"))
    s = supplied.groupBy(F.col(key).alias("_s")).agg(F.count("*").alias("_n"), F.min(F.struct(*facts)).alias("_sf"))
    j = e.join(s, F.col("_e") == F.col("_s"), "full_outer")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate").when(~F.col("_ef").eqNullSafe(F.col("_sf")), "mismatch")
    return j.select(F.coalesce("_e", "_s").alias(key), problem.alias("problem")).where("problem is not null")


def unresolved(edges: DataFrame, records: DataFrame, target: str, key: str) -> DataFrame:
    """Edges whose target is no record; edges without target (external ones) are resolved."""
    known = records.select(F.col(key).alias(target)).distinct()
    return edges.where(F.col(target).isNotNull()).join(known, target, "left_anti")


def lineage(records: DataFrame, key: str, predecessor: str, group: str) -> DataFrame:
    """One row of each group of records: how many records, roots, terminals (no successor), forks (a predecessor used twice) and lost predecessors."""
    r = records.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(predecessor).alias("p"))
    used = r.where("p is not null").groupBy(F.col("g").alias("ug"), F.col("p").alias("up")).agg(F.count("*").alias("uses"))
    j = r.join(used, (F.col("g") == F.col("ug")) & (F.col("k") == F.col("up")), "left")
    known = r.select(F.col("g").alias("kg"), F.col("k").alias("kk"), F.lit(True).alias("known")).distinct()
    j = j.join(known, (F.col("g") == F.col("kg")) & (F.col("p") == F.col("kk")), "left")
    out = j.groupBy(F.col("g").alias(group)).agg(F.count("*").alias("records"), F.count_if(F.col("p").isNull()).alias("roots"), F.count_if(F.col("uses").isNull()).alias("terminals"), F.count_if(F.col("uses") > 1).alias("forks"), F.count_if(F.col("p").isNotNull() & F.col("known").isNull()).alias("lost"))
    return out


def answers(questions: DataFrame, given: DataFrame) -> DataFrame:
    """(question_id, problem): unknown answers, missing required ones, and answers of a wrong type."""
    q = questions.select(F.col("question_id").alias("_q"), "required", F.col("type").alias("_t"))
    j = q.join(given, F.col("_q") == F.col("question_id"), "full_outer")
    problem = F.when(F.col("_q").isNull(), "unknown").when(F.col("question_id").isNull() & F.col("required"), "missing").when(F.col("question_id").isNotNull() & (F.col("_t") != F.col("type")), "wrong_type")
    return j.select(F.coalesce("_q", "question_id").alias("question_id"), problem.alias("problem")).where("problem is not null")


def expansion(artifacts: DataFrame, present: DataFrame) -> DataFrame:
    """(path, action): add what is absent, preserve what is there with the same kind, block on another kind."""
    p = present.select("path", F.col("kind").alias("_k"))
    action = F.when(F.col("_k").isNull(), "add").when(F.col("_k") == F.col("kind"), "preserve").otherwise("block")
    return artifacts.join(p, "path", "left").select("path", action.alias("action"))


def rendered(template, answers: dict[str, str]):
    """A template column with each ${id} replaced in one pass, so that an answer's own text is left alone; a placeholder that no answer fills makes the result null."""
    open_ = r"\$\{"
    known = F.create_map(*[F.lit(x) for pair in sorted(answers.items()) for x in pair]) if answers else F.create_map().cast("map<string,string>")
    pieces = F.split(template, open_, -1)

    def filled(piece):
        value = F.element_at(known, F.substring_index(piece, "}", 1))
        return F.when(piece.contains("}"), F.concat(value, F.substring(piece, F.length(F.substring_index(piece, "}", 1)) + 2, F.length(piece))))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), filled)
    return F.when(F.forall(rest, lambda p: p.isNotNull()), F.concat(pieces[0], F.array_join(rest, "")))


def file_tombstones(tombstones: DataFrame) -> DataFrame:
    """Tombstones of files whose last version is known: what a package must hold besides live files."""
    return tombstones.where((F.col("deleted_kind") == FILE) & F.col("last_object_version_id").isNotNull())


def coverage(expected: DataFrame, staged: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one side has, repeats included, with `side`: expected or staged. Nothing means that they are equal."""
    e, s = expected.select(*columns), staged.select(*columns)
    return e.exceptAll(s).withColumn("side", F.lit("expected")).unionByName(s.exceptAll(e).withColumn("side", F.lit("staged")))


def reference_findings(bindings: DataFrame, records: DataFrame) -> DataFrame:
    """(path, problem) of bindings (path, object_id, object_version_id, content_sha256) whose version record (object_version_id, object_id, sha256) is `missing`, of another object (`owner`) or of another content (`digest`). Directories have none."""
    r = records.select("object_version_id", F.col("object_id").alias("_o"), F.col("sha256").alias("_s"))
    j = bindings.where("object_version_id is not null").join(r, "object_version_id", "left")
    problem = F.when(F.col("_o").isNull(), "missing").when(F.col("_o") != F.col("object_id"), "owner").when(F.col("_s") != F.col("content_sha256"), "digest")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def manifest_closure(references: DataFrame, manifests: DataFrame) -> DataFrame:
    """(manifest_sha256, problem): manifests of a package that no reference names (`unreferenced`), named ones that it lacks (`missing`), held ones that come twice (`duplicate`), and those whose object differs from the reference's (`identity`). Both sides: manifest_sha256, object_id."""
    r = references.groupBy("manifest_sha256").agg(F.min("object_id").alias("_r"))
    m = manifests.groupBy(F.col("manifest_sha256").alias("_m")).agg(F.count("*").alias("_n"), F.min("object_id").alias("_o"))
    j = r.join(m, F.col("manifest_sha256") == F.col("_m"), "full_outer")
    problem = F.when(F.col("_m").isNull(), "missing").when(F.col("manifest_sha256").isNull(), "unreferenced").when(F.col("_n") > 1, "duplicate").when(F.col("_r") != F.col("_o"), "identity")
    return j.select(F.coalesce("manifest_sha256", "_m").alias("manifest_sha256"), problem.alias("problem")).where("problem is not null")


def package_plan(bindings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What a package must hold to make a root again: live files and links, and deleted files whose version is known (object_id, object_version_id, kind, path, deleted)."""
    live = bindings.where("kind <> 'directory'").select("object_id", "object_version_id", "kind", "path", F.lit(False).alias("deleted"))
    dead = file_tombstones(tombstones).select("object_id", F.col("last_object_version_id").alias("object_version_id"), F.col("deleted_kind").alias("kind"), "path", F.lit(True).alias("deleted"))
    return live.unionByName(dead)


#: What each kind of operation needs of its paths before it runs: of `path`, and of `to`.
REQUIREMENTS = {"create_directory": ("absent", None), "write_file": ("absent", None), "move": ("tracked", "absent"), "remove": ("tracked", None), "update": ("tracked", None)}


def required(operations: DataFrame) -> DataFrame:
    """(path, need) of operations (index, kind, path, to): what must be absent, tracked, or a directory (the parents of what is made), unless an operation makes that directory."""
    needs = []
    for kind, (of_path, of_to) in REQUIREMENTS.items():
        mine = operations.where(F.col("kind") == kind)
        needs.append(mine.select("path", F.lit(of_path).alias("need")))
        if of_to:
            needs.append(mine.select(F.col("to").alias("path"), F.lit(of_to).alias("need")))
    made = operations.where(F.col("kind") == "create_directory").select("path")
    new = operations.select(F.when(F.col("kind") == "move", F.col("to")).when(F.col("kind").isin("create_directory", "write_file"), F.col("path")).alias("path")).where("path like '%/%'")
    parents = new.select(F.substring_index("path", "/", -1).alias("_n"), "path").select(F.expr("substring(path, 1, length(path) - length(_n) - 1)").alias("path")).distinct().join(made, "path", "left_anti")
    needs.append(parents.withColumn("need", F.lit("directory")))
    return reduce(DataFrame.unionByName, needs).distinct()


def scope_problems(operations: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, problem): what operations need and the declared scope (path, need) doesn't have (`undeclared`), has without use (`unneeded`), or has otherwise (`differs`)."""
    n = required(operations).groupBy("path").agg(F.array_sort(F.collect_set("need")).alias("_n"))
    d = declared.groupBy(F.col("path").alias("_p")).agg(F.array_sort(F.collect_set("need")).alias("_d"))
    j = n.join(d, F.col("path") == F.col("_p"), "full_outer")
    problem = F.when(F.col("_p").isNull(), "undeclared").when(F.col("path").isNull(), "unneeded").when(F.col("_n") != F.col("_d"), "differs")
    return j.select(F.coalesce("path", "_p").alias("path"), problem.alias("problem")).where("problem is not null")


def early_operations(operations: DataFrame) -> DataFrame:
    """Operations (index, kind, path, to) that make something below a directory that only a later operation creates."""
    made = operations.where(F.col("kind") == "create_directory").select(F.col("path").alias("_up"), F.col("index").alias("_made"))
    target = F.when(F.col("kind") == "move", F.col("to")).otherwise(F.col("path"))
    each = operations.where(F.col("kind").isin("create_directory", "write_file", "move")).select("index", "kind", F.explode(ancestors(target)).alias("_up"))
    return each.join(made, "_up").where("_made > index").select("index", "kind").distinct()


#: Members that each kind of operation must and may have.
OPERATION_FIELDS = {"create_directory": ({"path"}, set()), "write_file": ({"path", "sha256"}, set()), "move": ({"path", "to"}, set()), "remove": ({"path"}, set()), "update": ({"path", "sha256"}, set())}


def operation_findings(operations: DataFrame) -> DataFrame:
    """(index, problem) of operations (index, kind, path, to, sha256) that aren't of one known form: unknown_kind, missing_<member>, unexpected_<member>, path_not_portable."""
    tests = [("unknown_kind", ~F.coalesce(F.col("kind").isin(*OPERATION_FIELDS), F.lit(False)))]
    for name in ("path", "to", "sha256"):
        must = F.col("kind").isin([k for k, (m, _) in OPERATION_FIELDS.items() if name in m])
        none = F.col("kind").isin([k for k, (m, o) in OPERATION_FIELDS.items() if name not in m | o])
        tests += [(f"missing_{name}", must & F.col(name).isNull()), (f"unexpected_{name}", none & F.col(name).isNotNull())]
    tests.append(("path_not_portable", ~(path_valid(F.col("path")) & F.coalesce(path_valid(F.col("to")), F.lit(True)))))
    found = F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in tests)), lambda c: c.isNotNull())
    return operations.select("index", F.explode(found).alias("problem"))


def package_findings(template: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(template_id, problem) of template packages: template (template_id, version), artifacts (template_id, target), upgrade edges (template_id, from_version, to_version).

    repeated_target (targets that collide when folded), unsafe_target, bad_version, edge_not_advancing, edge_beyond_version,
    and forked_edge (two upgrades from one version). Edges that all advance have no cycle.
    """
    t = template.select("template_id", semver(F.col("version")).alias("_v"))
    twice = artifacts.groupBy("template_id", folded(F.col("target")).alias("_k")).agg(F.count("*").alias("n")).where("n > 1").select("template_id", F.lit("repeated_target").alias("problem"))
    unsafe = artifacts.where(~path_valid(F.col("target"))).select("template_id", F.lit("unsafe_target").alias("problem"))
    bad = t.where("_v is null").select("template_id", F.lit("bad_version").alias("problem"))
    e = edges.select("template_id", semver(F.col("from_version")).alias("_a"), semver(F.col("to_version")).alias("_b")).join(t, "template_id")
    stuck = e.where(~F.coalesce(F.col("_a") < F.col("_b"), F.lit(False))).select("template_id", F.lit("edge_not_advancing").alias("problem"))
    beyond = e.where(F.col("_b") > F.col("_v")).select("template_id", F.lit("edge_beyond_version").alias("problem"))
    fork = e.groupBy("template_id", "_a").agg(F.count("*").alias("n")).where("n > 1").select("template_id", F.lit("forked_edge").alias("problem"))
    return reduce(DataFrame.unionByName, [twice, unsafe, bad, stuck, beyond, fork]).distinct()


def registry(templates: DataFrame) -> DataFrame:
    """Templates (template_id, version, name) with `latest`, whether no other version of the template is higher."""
    v = templates.withColumn("_v", semver(F.col("version")))
    top = v.groupBy("template_id").agg(F.max("_v").alias("_top"))
    return v.join(top, "template_id").withColumn("latest", F.col("_v").eqNullSafe(F.col("_top"))).drop("_v", "_top")


def initialisation(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action) of planned writes (path, kind): add, preserve what is there with the same kind, `collision` with another kind or with a path that differs only when folded."""
    e = existing.groupBy(folded(F.col("path")).alias("_k")).agg(F.collect_set(F.struct("path", "kind")).alias("_here"))
    p = planned.withColumn("_k", folded(F.col("path"))).join(e, "_k", "left")
    same = F.array_contains("_here", F.struct("path", "kind"))
    return p.select("path", F.when(F.col("_here").isNull(), "add").when(same & (F.size("_here") == 1), "preserve").otherwise("collision").alias("action"))


def decoded_versions(texts: DataFrame, most_bytes: int = 64 << 20, most_entries: int = 16_384) -> DataFrame:
    """(version_id, problem, root_id, parents, entries) of versions as JSON (version_id, json): too_large before anything is read, then invalid_json, then too_many_entries counted before any entry is made, and wrong_id."""
    small = F.octet_length("json") <= most_bytes
    v = texts.withColumn("_v", F.when(small, F.try_parse_json("json")))
    size = lambda name: F.coalesce(F.size(F.try_variant_get("_v", f"$.{name}", "array<variant>")), F.lit(0))
    entries = size("bindings") + size("tombstones") + size("exclusions")
    own = F.try_variant_get("_v", "$.version_id", "string")
    problem = F.when(~small, "too_large").when(F.col("_v").isNull(), "invalid_json").when(entries > most_entries, "too_many_entries").when(~own.eqNullSafe(F.col("version_id")), "wrong_id")
    good = problem.isNull()
    return v.select("version_id", problem.alias("problem"), F.when(good, F.try_variant_get("_v", "$.root_id", "string")).alias("root_id"), F.when(good, F.try_variant_get("_v", "$.parents", "array<string>")).alias("parents"), F.when(good, entries).alias("entries"))


def draft_findings(drafts: DataFrame, questions: DataFrame, given: DataFrame, operations: DataFrame, most: int = 4096) -> DataFrame:
    """(draft_id, problem) of reorganisation drafts (draft_id, scope): no_operations or too_many_operations, repeated_question, unanswered (a required one), outside_scope (an operation's path not below the scope), and repeated_path (two operations on one folded path).

    questions: draft_id, question_id, required; given: draft_id, question_id; operations: draft_id, path.
    """
    flag = lambda df, name: df.select("draft_id", F.lit(name).alias("problem"))
    n = drafts.select("draft_id").join(operations.groupBy("draft_id").agg(F.count("*").alias("n")), "draft_id", "left").fillna(0, ["n"])
    placed = operations.join(drafts, "draft_id")
    found = [
        flag(n.where("n = 0"), "no_operations"),
        flag(n.where(F.col("n") > most), "too_many_operations"),
        flag(questions.groupBy("draft_id", "question_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_question"),
        flag(questions.where("required").join(given.select("draft_id", "question_id"), ["draft_id", "question_id"], "left_anti"), "unanswered"),
        flag(placed.where(~at_or_below(F.col("path"), F.col("scope"))), "outside_scope"),
        flag(operations.groupBy("draft_id", folded(F.col("path")).alias("_k")).agg(F.count("*").alias("n")).where("n > 1"), "repeated_path"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
