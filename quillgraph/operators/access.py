"""Who may see and change what: cohorts of pages, visibility, grants, and the default access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def cohort_pages(pages: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(cohort, slug): the cohorts that a page names itself, else those whose glob fits; a null glob fits all.

    pages(slug, cohorts array), cohorts(cohort, pattern), the pattern as a regular expression. Cohorts are few: they
    come from a configuration, so every page without its own is tried against each of them.
    """
    named = pages.select("slug", F.explode("cohorts").alias("cohort")).join(cohorts.select("cohort"), "cohort", "left_semi").select("cohort", "slug")
    free = pages.filter(F.col("cohorts").isNull() | (F.size("cohorts") == 0)).select("slug")
    fitted = free.join(F.broadcast(cohorts), F.col("pattern").isNull() | F.expr("slug rlike pattern")).select("cohort", "slug")
    return named.unionByName(fitted).distinct()


def scoped_backlinks(edges: DataFrame, members: DataFrame, target: str) -> DataFrame:
    """(cohort, source): who links to target, seen from each cohort that holds both."""
    own = members.filter(F.col("slug") == target).select("cohort")
    return edges.filter(F.col("target") == target).select(F.col("source").alias("slug")).join(members.join(own, "cohort", "left_semi"), "slug").select("cohort", F.col("slug").alias("source")).distinct()


def visible(pages: DataFrame, denied: DataFrame) -> DataFrame:
    return pages.join(denied.select("slug").distinct(), "slug", "left_anti")


def grant_states(grants: DataFrame, now: str) -> DataFrame:
    """grants(id, expires_at, revoked) with `state`: active, expired, revoked, expired_revoked."""
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    gone = F.coalesce(F.col("revoked"), F.lit(False))
    return grants.withColumn("state", F.when(expired & gone, "expired_revoked").when(expired, "expired").when(gone, "revoked").otherwise("active"))


def decide(queries: DataFrame, users: DataFrame, scopes: DataFrame) -> DataFrame:
    """(user, page, action, allowed, tag) by the default rules, for queries(user, page, action), all at once.

    users(user, role, owner, agent) and scopes(user, pattern), the pattern as a regular expression. An owner may do
    everything, strictly. Anyone known may read. Admins may edit, but an agent never the page `access`. Editors may read
    and edit, and readers read, within their scopes. What nothing grants is denied.
    """
    known = queries.join(users, "user", "left")
    inside = queries.select("user", "page").distinct().join(scopes, "user").filter(F.expr("page rlike pattern")).select("user", "page").distinct().withColumn("in_scope", F.lit(True))
    q = known.join(inside, ["user", "page"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    admin = (F.col("role") == "admin") | yes("owner")
    editor = (F.col("role") == "editor") & yes("in_scope")
    barred = yes("agent") & (F.col("page") == "access")
    grants = F.when(F.col("action") == "read", F.lit(True)).otherwise(F.coalesce((admin | editor) & ~barred, F.lit(False)))
    tag = F.when(yes("owner"), "+D").when(grants, "+d").otherwise("-d")
    return q.select("user", "page", "action", tag.isin("+D", "+d").alias("allowed"), tag.alias("tag"))


def apply_overlay(decisions: DataFrame, forbidden: DataFrame) -> DataFrame:
    """decisions with forbidden(user, page, action, tag) applied: an active prohibition overrules a grant."""
    ban = forbidden.filter(F.col("tag").isin("+D", "+d")).groupBy("user", "page", "action").agg(F.min("tag").alias("_ban"))
    joined = decisions.join(ban, ["user", "page", "action"], "left")
    hit = F.col("allowed") & F.col("_ban").isNotNull()
    return joined.select("user", "page", "action", (F.col("allowed") & ~hit).alias("allowed"), F.when(hit, F.col("_ban")).otherwise(F.col("tag")).alias("tag"))


def violations(changed_pages: DataFrame, users: DataFrame, scopes: DataFrame) -> DataFrame:
    """Edits of changed_pages(page, user) that the user may not make."""
    return decide(changed_pages.select("user", "page", F.lit("edit").alias("action")).distinct(), users, scopes).filter("not allowed")


def temporal_facts(intervals: DataFrame, now: int) -> DataFrame:
    """(literal, fact) for intervals(literal, start, end): `active` inside, `now-within` from its first to its last moment."""
    rel = dates.temporal_relation(F.lit(now), F.col("start"), F.col("end"))
    both = intervals.select("literal", rel.alias("relation"))
    return both.filter(F.col("relation").isin("meets", "within", "finishes")).select("literal", "relation", F.explode(F.array(F.lit("active"), F.lit("now-within"))).alias("fact"))


def _lit(name: str, *cols: str):
    """A literal of quoted names, as the rule language writes it."""
    from pyspark.sql import Column

    quoted = [F.concat(F.lit(' "'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in cols]
    out: Column = F.concat(F.lit(f"({name}"), *quoted, F.lit(")"))
    return out


def evaluate(queries: DataFrame, users: DataFrame, scopes: DataFrame, policy=None) -> DataFrame:
    """(user, page, action, allowed, tag): the default rules, grounded for all queries at once, with a policy's rules, reasoned about.

    The same tables as decide(), which is the short way where there is no policy. policy is a Theory; its facts about
    owners don't count. What has no conclusion is denied.
    """
    from ..logic import reason
    from ..logic.rules import Theory

    pairs = queries.select("user", "page").distinct()
    known = pairs.join(users, "user", "left")
    inside = pairs.join(scopes, "user").filter(F.expr("page rlike pattern")).select("user", "page").distinct().withColumn("in_scope", F.lit(True))
    q = known.join(inside, ["user", "page"], "left")
    lit = {n: _lit(n, *cols) for n, cols in (("authenticated", ("user",)), ("owner", ("user",)), ("admin", ("user",)), ("is-agent", ("user",)), ("in-scope", ("page", "user")), ("can-read", ("user", "page")), ("can-edit", ("user", "page")))}
    role = lambda r: F.concat(F.lit('(role "'), F.col("user"), F.lit(f'" {r})'))
    bar = F.concat(F.lit('~(can-edit "'), F.col("user"), F.lit('" "access")'))
    defaults = [
        ("r-default-read", "defeasible", [lit["authenticated"]], lit["can-read"]), ("s-owner-read", "strict", [lit["owner"]], lit["can-read"]), ("s-owner-edit", "strict", [lit["owner"]], lit["can-edit"]),
        ("r-admin-edit", "defeasible", [lit["admin"]], lit["can-edit"]), ("d-agent-no-acl", "defeater", [lit["is-agent"]], bar), ("r-scoped-read", "defeasible", [role("reader"), lit["in-scope"]], lit["can-read"]),
        ("r-scoped-edit", "defeasible", [role("editor"), lit["in-scope"]], lit["can-edit"]), ("r-scoped-edit-read", "defeasible", [role("editor"), lit["in-scope"]], lit["can-read"]),
    ]
    name = lambda label: F.concat_ws("|", F.lit(label), "user", "page")
    each = F.array(*(F.struct(name(label).alias("label"), F.lit(kind).alias("kind"), head.alias("head"), F.array(*body).alias("body")) for label, kind, body, head in defaults))
    rules = q.select(F.explode(each).alias("r")).select("r.*")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    given = F.array(
        lit["authenticated"], F.when(yes("owner"), lit["owner"]), F.when(yes("owner") | F.coalesce(F.col("role") == "admin", F.lit(False)), lit["admin"]), F.when(yes("agent"), lit["is-agent"]),
        F.when(F.col("role").isNotNull(), F.concat(F.lit('(role "'), F.col("user"), F.lit('" '), F.col("role"), F.lit(")"))), F.when(yes("in_scope"), lit["in-scope"]),
    )
    place = [F.lit("defaults").alias("path"), F.lit(1).alias("line"), F.lit("defaults").alias("page")]
    facts = q.select(F.explode(given).alias("literal")).filter("literal is not null").distinct().select(F.concat(F.lit("given:"), "literal").alias("label"), "literal", *place)
    sup = q.filter("page = 'access'").select(name("d-agent-no-acl").alias("superior"), name("r-admin-edit").alias("inferior"))
    theory = Theory.__new__(Theory)
    theory.rules = rules.select("label", "kind", "head", *place)
    theory.body = rules.select("label", F.posexplode("body").alias("pos", "literal"))
    theory.facts, theory.superiority = facts, sup
    if policy is not None:
        own = policy.facts.filter(~F.col("literal").startswith("(owner "))
        theory.rules, theory.body = theory.rules.unionByName(policy.rules), theory.body.unionByName(policy.body)
        theory.facts, theory.superiority = theory.facts.unionByName(own), theory.superiority.unionByName(policy.superiority)
    found = reason.strongest(reason.conclusions(theory))
    want = F.when(F.col("action") == "read", lit["can-read"]).otherwise(lit["can-edit"])
    asked = queries.withColumn("literal", want).join(found, "literal", "left")
    tag = F.when(F.col("tag").isin("+D", "+d"), F.col("tag")).otherwise("-d")
    return asked.select("user", "page", "action", tag.isin("+D", "+d").alias("allowed"), tag.alias("tag"))


def prune_comments(comments: DataFrame, cutoff: str) -> DataFrame:
    """comments(at, ...) not older than a time; texts of times compare."""
    return comments.filter(F.col("at") >= cutoff)


def verify_comments(comments: DataFrame, key: bytes) -> DataFrame:
    """comments(body, hmac, ...) with `valid`: whether the SHA-256 HMAC of the body under the key is as stored.

    HMAC is two nested digests over padded keys, which built-in functions give.
    """
    import hashlib

    k = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(x ^ b for x in k))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.coalesce(F.col("body"), F.lit("")).cast("binary")), 256))
    return comments.withColumn("valid", F.coalesce(F.sha2(F.concat(pad(0x5C), inner), 256) == F.lower("hmac"), F.lit(False)))
