"""Located findings: rule matches and high-entropy values, by native expressions over each file's content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


class Rule(NamedTuple):
    """A regex (Java), and what a finding of it says. ``anchors``: of each list one member must stand in the lowered text."""

    id: str
    name: str
    severity: str
    pattern: str
    description: str = ""
    recommendation: str = ""
    anchors: tuple[tuple[str, ...], ...] = ()
    languages: tuple[str, ...] = ()
    skip_comments: bool = False


# The scan's rules (id, name, severity, Java regex).
RULES: list[Rule] = [
    Rule("hardcoded_secret", "Hardcoded credential", "CRITICAL", r"""(?idU)\b[\w.]*(?:api[_-]?key|secret|token|password|passwd|passphrase|credential|private[_-]?key)\w*\s*[:=]\s*["'][^"'\n]{12,}["']""", "A literal is assigned to a name that speaks of a credential.", "Read it from the environment or a secret store, and rotate what was committed.", (("key", "secret", "token", "passw", "passphrase", "credential"), ('"', "'"), (":", "=")), skip_comments=True),
    Rule("aws_access_key", "AWS access key id", "CRITICAL", r"(?dU)\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", "The text has the shape of an AWS access key id.", "Revoke the key and let the workload's role supply one.", (("akia", "asia"),)),
    Rule("private_key_block", "Private key material", "CRITICAL", r"(?dU)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "The head of a PEM private key.", "Take the key out of the history, replace it, and keep its successor elsewhere.", (("private key-----",),)),
    Rule("github_token", "GitHub personal access token", "CRITICAL", r"(?dU)\b(gh[pousr]_[A-Za-z0-9]{36,})\b", "A GitHub prefix and 36 or more token characters.", "Revoke the token; let the pipeline's secrets hold the next one.", (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),)),
    Rule("slack_token", "Slack token", "HIGH", r"(?dU)\b(xox[abposr]-[A-Za-z0-9-]{10,})\b", "The shape of a Slack API token.", "Revoke the token and configure the next one at run time.", (("xox",),)),
    Rule("unsafe_deserialization", "Unsafe deserialization", "HIGH", r"(?dU)\b(pickle\.loads?|cPickle\.loads?|marshal\.loads?|yaml\.load\s*\((?![^)]*Loader\s*=)|dill\.loads?)\b", "The loader runs code that its input names.", "Load data-only formats, or the loader's safe form.", ((".load",),)),
    Rule("code_execution", "Dynamic code execution", "HIGH", r"(?dU)\b(eval|exec)\s*\(", "A string becomes running code.", "Choose among known functions, or parse the input.", (("eval", "exec"), ("(",))),
    Rule("shell_injection", "Shell command execution", "HIGH", r"(?dU)(os\.system\s*\(|subprocess\.(?:run|call|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True|child_process\.exec\s*\()", "A shell interprets the command; what users supply in it becomes commands.", "Call the program with a list of arguments and without a shell.", (("os.system", "subprocess.", "child_process.exec"),)),
    Rule("sql_injection", "SQL built by string formatting", "HIGH", r"""(?idU)(?:SELECT|INSERT|UPDATE|DELETE)\b[^\n]{0,160}?(?:%\s*\(?\s*\w|["']\s*\+\s*\w|\{\s*\w+\s*\}|f["'][^\n]*\{)""", "Values are written into the text of a statement.", "Bind values as parameters.", (("select", "insert", "update", "delete"), ("%", "+", "{"))),
    Rule("path_traversal", "Unvalidated path join", "MEDIUM", r"(?dU)(?:os\.path\.join|path\.join|Path)\s*\([^)]*(?:request|params|args|query|user_input|input)\b", "A path is joined with what a request supplied.", "Resolve the path and refuse what lies outside its folder.", (("path",), ("request", "params", "args", "query", "input"))),
    Rule("weak_hash", "Weak hash for security use", "MEDIUM", r"(?dU)\b(hashlib\.(?:md5|sha1)|createHash\s*\(\s*['\"](?:md5|sha1)['\"])", "MD5 and SHA-1 no longer resist forgery.", "Use SHA-256; for passwords a password hash.", (("hashlib.", "createhash"),)),
    Rule("insecure_random", "Insecure randomness", "MEDIUM", r"(?dU)\b(random\.(?:random|randint|choice|randrange)|Math\.random)\s*\(", "The generator can be predicted.", "Use the system's secure source for tokens and keys.", (("random",), ("(",))),
    Rule("insecure_transport", "TLS verification disabled", "HIGH", r"(?dU)(verify\s*[:=]\s*(?:False|false|0)|rejectUnauthorized\s*:\s*false|curl\s+(?:-k|--insecure)\b|InsecureSkipVerify\s*:\s*true|ssl\._create_unverified_context)", "Certificates are not checked, so anyone may answer.", "Check them, with the right authority installed.", (("verify", "rejectunauthorized", "curl", "_create_unverified_context"),)),
    Rule("debug_mode", "Debug mode in production code", "MEDIUM", r"(?idU)\b(DEBUG\s*=\s*True|debug\s*=\s*true)\b", "Debugging shows internals to visitors.", "Let configuration switch it, off by default.", (("debug",),)),
    Rule("xss_innerhtml", "Unescaped HTML injection", "MEDIUM", r"(?dU)\.innerHTML\s*=(?!\s*['\"`]\s*;?\s*$)[^=]", "Assigned markup is rendered as it stands.", "Assign text, or sanitise the markup.", ((".innerhtml",),)),
    Rule("jwt_none_algorithm", "JWT signature not verified", "HIGH", r"""(?dU)(verify\s*=\s*False|algorithms\s*=\s*\[\s*["']none["']\s*\]|jwt\.decode\([^)]*verify\s*=\s*False)""", "A token is believed without its signature.", "Verify it against the issuer's key and a fixed algorithm.", (("verify", "algorithms", "jwt.decode"),)),
    Rule("open_redirect", "Unvalidated redirect target", "MEDIUM", r"(?idU)(redirect|sendRedirect|location\.href\s*=\s*(?:document\.)?window\.(?:location|URLSearchParams))", "The target of a redirect comes from outside.", "Redirect to relative or listed targets alone.", (("redirect", "location.href"),)),
    Rule("cors_wildcard", "Wildcard CORS with credentials", "MEDIUM", r"""(?idU)(Access-Control-Allow-Origin[^\n]{0,40}\*|allow_origins\s*=\s*\[\s*["']\*["']\s*\])""", "Every origin may read the answer.", "Name the origins that need it.", (("access-control-allow-origin", "allow_origins"), ("*",))),
]
# Names of credentials, and a value long enough to be judged by its entropy.
ASSIGNMENT = r"""(?iU)\b([A-Za-z0-9_]*(?:key|secret|token|password|passwd|credential|auth)[A-Za-z0-9_]*)\s*[:=]\s*["']([^"'\n]{24,})["']"""
ENTROPY = Rule("high_entropy_value", "High-entropy value assigned to a credential-like name", "HIGH", ASSIGNMENT, "A value with the entropy of a generated key.", "Rotate it if it is real, and load it from configuration.", (("key", "secret", "token", "passw", "credential", "auth"), ('"', "'"), (":", "=")))
#: A cheaper pattern, of lowered text, that every match of the two credential patterns satisfies.
_ASSIGNED = r"""(?U)(?:key|secret|token|password|passwd|passphrase|credential|auth)\w*\s*[:=]\s*["']"""
PER_RULE, LONGEST_LINE = 5, 1000
_CUT = "\x01"
_HIT = "array<struct<line:int,text:string,value:string>>"


def _fires(rule: Rule) -> Column:
    """Whether the rule may fire on ``content`` (lowered: ``low``): the cheap tests stand first and spare most regexes."""
    tests = [reduce(lambda a, b: a | b, [F.contains("low", F.lit(x)) for x in group]) for group in rule.anchors]
    if rule.pattern in (ASSIGNMENT, RULES[0].pattern):
        tests.append(F.col("low").rlike(_ASSIGNED))
    if rule.languages:
        tests.append(F.coalesce(F.col("language").isin("", *rule.languages), F.lit(True)))
    return reduce(lambda a, b: a & b, [*tests, F.col("content").rlike(rule.pattern)])


def _matched(rule: Rule, per_rule: int) -> Column:
    """The first ``per_rule`` lines on which a match begins: matches are marked in the whole text, which is then cut at its line ends."""
    marked = F.transform(F.split(F.regexp_replace("content", rule.pattern, _CUT + "$0"), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = F.transform(F.filter(marked, lambda h: F.contains(h["text"], F.lit(_CUT))), lambda h: F.struct(h["line"].alias("line"), F.replace(h["text"], F.lit(_CUT), F.lit("")).alias("text"), F.lit(None).cast("string").alias("value")))
    if rule.skip_comments:
        hits = F.filter(hits, lambda h: ~(X.is_comment(h["text"]) | X.snippet(h["text"]).rlike(X.LOW_SIGNAL)))
    return F.slice(hits, 1, per_rule)


def _random() -> Column:
    """Every value under the name of a credential, by line; whether it looks random is judged later."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    kept = F.filter(lines, lambda h: (F.length(h["text"]) <= LONGEST_LINE) & h["text"].rlike(ASSIGNMENT) & ~X.is_comment(h["text"]) & ~h["text"].rlike(X.LOW_SIGNAL))
    values = F.transform(kept, lambda h: F.transform(F.regexp_extract_all(h["text"], F.lit(ASSIGNMENT), F.lit(2)), lambda v: F.struct(h["line"].alias("line"), h["text"].alias("text"), v.alias("value"))))
    return F.filter(F.flatten(values), lambda h: ~h["value"].rlike(X.NOT_SECRET))


def _keys(files: DataFrame) -> list[str]:
    return [c for c in ("repo_id", "file_path") if c in files.columns]


def texts(files: DataFrame) -> DataFrame:
    """keys, language, content with clean line ends, and low: what is scanned of files; no manifests, documents or empty texts."""
    for flag in ("is_manifest", "is_document"):
        if flag in files.columns:
            files = files.filter(~F.coalesce(flag, F.lit(False)))
    language = F.col("language") if "language" in files.columns else F.lit("")
    content = F.when(F.contains("content", F.lit("\r")), X.clean_lines(F.col("content"))).otherwise(F.col("content"))
    clean = F.when(F.contains("content", F.lit(_CUT)), F.replace(content, F.lit(_CUT), F.lit(" "))).otherwise(content)
    # upper case first: it gives what a regex that ignores case takes for an ASCII letter
    return files.filter("content <> ''").select(*_keys(files), language.alias("language"), clean.alias("content")).withColumn("low", F.lower(F.upper("content")))


def findings(files: DataFrame, rules: Sequence[Rule] = RULES, per_rule: int = PER_RULE, entropy: bool = True) -> DataFrame:
    """Located findings of files(repo_id?, file_path, content, language?, is_manifest?, is_document?), an id for each place.

    Of each rule the first ``per_rule`` lines of a file, and every random-looking value under the name of a
    credential. One pass without a shuffle: a text is cleaned once, a regex sees only texts with its anchors, and
    only texts that match are cut up, in time linear in their length. Manifests, documents, empty and null texts have
    none; a repeated file has its findings as often.
    """
    keys, every, some = _keys(files), [*rules, *([ENTROPY] if entropy else [])], texts(files)
    fired = F.filter(F.array(*[F.when(_fires(r), F.lit(i)) for i, r in enumerate(every)]), lambda x: x.isNotNull())
    some = some.select(*keys, "content", F.explode(fired).alias("no"))
    hits = F.lit(None).cast(_HIT)
    for i, rule in enumerate(every):
        hits = F.when(F.col("no") == i, _random() if rule is ENTROPY else _matched(rule, per_rule)).otherwise(hits)
    located = some.select(*keys, "no", F.explode(hits).alias("h")).select(*keys, "no", "h.line", "h.text", "h.value")
    if entropy:
        located = located.withColumn("entropy", F.when(F.col("value").isNotNull(), X.entropy(F.col("value")))).filter(F.col("value").isNull() | X.looks_random(F.col("value"), F.col("entropy")))
    else:
        located = located.withColumn("entropy", F.lit(None).cast("double"))
    say = lambda field: F.element_at(F.array(*[F.lit(getattr(r, field)) for r in every]), F.col("no") + 1)
    random = F.col("value").isNotNull()
    return located.select(
        F.concat_ws(":", say("id"), "file_path", "line").alias("id"), *keys, say("id").alias("rule"), say("name").alias("name"), say("severity").alias("severity"), say("description").alias("description"),
        F.col("line").cast("bigint").alias("line"), X.snippet(F.col("text")).alias("snippet"), say("recommendation").alias("recommendation"), F.when(random, "entropy").otherwise("pattern").alias("detector"),
        F.when(F.col("entropy") < 4.6, "low").otherwise("medium").alias("confidence"), F.lit("static-analysis").alias("source"), F.lit("pending").alias("triage"), "entropy",
    )


def rule_findings(files: DataFrame, rules: Sequence[Rule] = RULES, per_rule: int = PER_RULE) -> DataFrame:
    return findings(files, rules, per_rule, entropy=False).drop("entropy")


def entropy_findings(files: DataFrame) -> DataFrame:
    return findings(files, [])
