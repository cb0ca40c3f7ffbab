"""Policy rules and gates: each rule one boolean expression, the heaviest triggered action wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import fixed


def heaviest(triggered: Column) -> Column:
    """struct<rank, neg_ord, rule, action> of the heaviest of array<struct<rule, action, ord>>; the lower ord of equals."""
    rank = F.create_map(*[F.lit(x) for kv in fixed.ACTION_RANK.items() for x in kv])
    return F.array_max(F.transform(triggered, lambda t: F.struct(F.element_at(rank, t.action).alias("rank"), (-t.ord).alias("neg_ord"), t.rule.alias("rule"), t.action.alias("action"))))


def _gate(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    all_rules = F.array(*[F.when(F.coalesce(check, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"), F.lit(k).alias("ord"))) for k, (name, action, check) in enumerate(rules)])
    hit = F.array_compact(all_rules)
    best = heaviest(hit)
    risk = F.create_map(*[F.lit(x) for kv in fixed.ACTION_RISK.items() for x in kv])
    out = rows.withColumn("triggered", F.transform(hit, lambda t: t.rule)).withColumn("rule", best.rule).withColumn("action", F.coalesce(best.action, F.lit("PASS")))
    return out.withColumn("risk", F.element_at(risk, F.col("action"))).withColumn("policy_version", F.lit(fixed.POLICY_VERSION))


def analysis_gate(contexts: DataFrame) -> DataFrame:
    """contexts with triggered, rule, action, risk and policy_version; the first rule of the registry wins ties.

    contexts: rollback_symbols, keep_symbols, affected_routes, changed_files (arrays), unsupported_findings,
    invalid_graph_paths, unresolved_test_failures (counts).
    """
    return _gate(contexts, [(name, action, F.expr(check)) for name, action, check in fixed.POLICY_RULES])


def single_rule(contexts: DataFrame, name: str) -> DataFrame:
    """contexts where one rule triggers."""
    return contexts.where(F.expr(next(check for rule, _, check in fixed.POLICY_RULES if rule == name)))


def pre_triggers() -> dict[str, Column]:
    """Checks of a plan: target_files, target_symbols, routes, rollback_symbols, keep_symbols (arrays)."""
    text = F.lower(F.concat_ws(" ", F.array_join("target_files", " "), F.array_join("target_symbols", " "), F.array_join("routes", " ")))
    held = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    short = lambda c: F.transform(c, lambda s: F.element_at(F.split(s, "::"), -1))
    return {"public_api_change": (F.size("routes") > 0) | held(fixed.ROUTE_WORDS), "auth_change": held(fixed.AUTH_WORDS), "same_symbol_rollback_keep": F.arrays_overlap(short("rollback_symbols"), short("keep_symbols"))}


def pre_gate(plans: DataFrame, actions: dict[str, str] | None = None) -> DataFrame:
    """plans with the gate's decision before execution; rules in alphabetical order, unknown actions are left out."""
    return _configured(plans, pre_triggers(), actions or fixed.PRE_GATE)


def post_gate(attempts: DataFrame, actions: dict[str, str] | None = None) -> DataFrame:
    """attempts (plan columns, status, scope_pass, preservation_pass, results array<string>) with the gate's decision.

    Missing verification passes; a result that is neither PASSED nor null fails the tests.
    """
    checks = {
        "unexpected_file_change": ~F.coalesce("scope_pass", F.lit(True)), "forbidden_keep_change": ~F.coalesce("preservation_pass", F.lit(True)), "repository_state_changed": F.col("status") == "STALE_PLAN",
        "apply_check_failed": F.col("status") == "CONFLICT", "test_failed": (F.col("status") == "TEST_FAILED") | F.exists("results", lambda r: F.coalesce(r, F.lit("PASSED")) != "PASSED"), **pre_triggers(),
    }
    return _configured(attempts, checks, actions or fixed.POST_GATE)


def _configured(rows: DataFrame, checks: dict[str, Column], actions: dict[str, str]) -> DataFrame:
    rules = [(name, actions[name], checks[name]) for name in sorted(checks) if actions.get(name) in ("HUMAN_REVIEW", "BLOCK")]
    return _gate(rows, rules)


def recommendation(action: Column, coupled: Column, gated: Column) -> Column:
    """BLOCK, then coupling or review, then ungated, then pass."""
    return F.when(action == "BLOCK", "BLOCK").when(coupled, "HUMAN_REVIEW").when(action == "HUMAN_REVIEW", "HUMAN_REVIEW").when(~gated, "UNGATED").otherwise("PASS")


def promotion_reasons() -> Column:
    """Why an attempt may not be promoted; an empty array if it may. Nothing is ever pushed."""
    checks = [("promotion is disabled", ~F.col("promote_enabled")), ("auto push is set", F.col("auto_push")), ("no explicit approval", ~F.coalesce("explicit_approval", F.lit(False))), ("not ready", F.col("status") != "READY_TO_PROMOTE"), ("patch differs from the verified one", ~F.col("patch_sha").eqNullSafe(F.col("verified_sha"))), ("repository moved on", F.col("stale"))]
    return F.array_compact(F.array(*[F.when(c, F.lit(reason)) for reason, c in checks]))


def capability_allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (skill, capability) with allowed: a grant (skill, pattern) names it, or a prefix ending in ``.*``."""
    matched = requests.join(grants, "skill").where((F.col("capability") == F.col("pattern")) | (F.endswith("pattern", F.lit(".*")) & F.startswith("capability", F.expr("left(pattern, length(pattern) - 1)"))))
    return requests.join(matched.select("skill", "capability").distinct().withColumn("_ok", F.lit(True)), ["skill", "capability"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def allowed_command(argv: Column, executables: list[str]) -> Column:
    """Whether a command's executable is on the white list and no shell is asked for."""
    first = F.element_at(F.split(F.get(argv, 0), "/"), -1)
    return F.coalesce(first.isin(executables) & ~F.exists(argv, lambda a: a.rlike(r"[;&|`$<>\n]")), F.lit(False))


def allowed_git(argv: Column, sandbox: bool = False) -> Column:
    """Whether a git command (its arguments, without ``git``) may run: one that only reads; in a sandbox one of those that
    sandboxes take, with no other flags than theirs, worktrees only added detached, indexes never written in place."""
    head = F.get(argv, 0)
    if not sandbox:
        return F.coalesce(head.isin(fixed.GIT_READS), F.lit(False))
    flags = F.create_map(*[x for k, v in fixed.GIT_SANDBOX_FLAGS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]).cast("array<string>"))])
    known = F.try_element_at(flags, head)
    rest = F.slice(argv, F.lit(2), F.size(argv))
    fits = F.forall(rest, lambda a: ~F.startswith(a, F.lit("-")) | F.array_contains(known, a))
    tree = (head != "worktree") | (F.coalesce(F.get(argv, 1).isin("add", "remove", "prune", "list"), F.lit(False)) & ((F.get(argv, 1) != "add") | F.array_contains(argv, "--detach")))
    index = (head != "read-tree") & ~((head == "apply") & F.array_contains(argv, "--cached"))
    return F.coalesce(known.isNotNull() & fits & tree & index, F.lit(False))


def gate_decisions(gated: DataFrame, key: str) -> DataFrame:
    """A decision row (category, target, statement, risk, policy_version, triggered) for each gated row, as a register keeps it."""
    said = F.concat_ws(": ", F.coalesce("rule", F.lit("no rule")), "action")
    return gated.select(F.lit("policy_gate").alias("category"), F.col(key).cast("string").alias("target"), said.alias("statement"), "risk", "policy_version", "triggered")
