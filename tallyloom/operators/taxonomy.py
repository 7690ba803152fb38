"""What commands without a rule are: family, class and the reducer that might serve them.

Fixed values: rows of programs, subcommands, family, class and reducer; ``{p}`` stands for the program,
``*`` for any subcommand, ``-`` for none. The first row that fits wins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXISTING, REVIEW, PASS, UNCLEAR = "existing_rule", "review_candidate", "required_pass_through", "unclear"
TABLE = [
    ("ls find fd tree du df", "*", "filesystem/{p}", REVIEW, "list_summary"),
    ("ps lsof free", "*", "system/{p}", REVIEW, "list_summary"),
    ("make ninja cmake meson msbuild", "*", "build/{p}", REVIEW, "build_summary"),
    ("bazel buck buck2", "test", "build-driver/test", REVIEW, "test_summary"),
    ("bazel buck buck2", "build check", "build-driver/build", REVIEW, "build_summary"),
    ("bazel buck buck2", "*", "build-driver/other", UNCLEAR, None),
    ("docker podman", "ps images stats", "container/inventory", REVIEW, "list_summary"),
    ("docker podman", "logs", "container/logs", REVIEW, "log_summary"),
    ("docker podman", "build buildx", "container/build", REVIEW, "build_summary"),
    ("docker podman", "inspect exec cp save export", "container/exact-or-structured", PASS, None),
    ("docker podman", "run start stop restart rm rmi pull push", "container/mutation", PASS, None),
    ("docker podman", "*", "container/other", UNCLEAR, None),
    ("kubectl", "events", "cluster/events", REVIEW, "log_summary"),
    ("kubectl", "top", "cluster/inventory", REVIEW, "list_summary"),
    ("kubectl", "logs", "cluster/logs", REVIEW, "log_summary"),
    ("kubectl", "get describe", "cluster/inspection", REVIEW, "list_summary"),
    ("kubectl", "exec cp port-forward proxy", "cluster/exact-or-streaming", PASS, None),
    ("kubectl", "apply create delete edit patch replace rollout", "cluster/mutation", PASS, None),
    ("kubectl", "*", "cluster/other", UNCLEAR, None),
    ("git", "tag remote worktree stash", "git/other-list", REVIEW, "list_summary"),
    ("git", "reflog", "git/reflog", REVIEW, "log_summary"),
    ("git", "show blame cat-file rev-parse ls-files ls-tree for-each-ref", "git/exact-inspection", PASS, None),
    ("git", "add commit push pull fetch merge rebase reset restore checkout switch cherry-pick revert clean gc", "git/mutation", PASS, None),
    ("git", "-", "git/no-subcommand", UNCLEAR, None),
    ("git", "*", "git/other", UNCLEAR, None),
    ("gh", "api", "gh/api", PASS, None),
    ("gh", "auth config alias extension secret variable", "gh/control-or-sensitive", PASS, None),
    ("gh", "pr issue run workflow release repo search", "gh/other-inspection", REVIEW, "list_summary"),
    ("gh", "*", "gh/other", UNCLEAR, None),
    ("npm pnpm yarn bun", "install add remove uninstall update upgrade publish", "package/mutation", PASS, None),
    ("npm pnpm yarn bun", "test coverage", "package/{p}-test-task", REVIEW, "test_summary"),
    ("npm pnpm yarn bun", "lint", "package/{p}-lint-task", REVIEW, "line_filter"),
    ("npm pnpm yarn bun", "check build typecheck", "package/{p}-build-task", REVIEW, "build_summary"),
    ("npm pnpm yarn bun", "*", "package/other-task", UNCLEAR, None),
    ("cargo go dotnet pytest ruff mypy pyright", "*", "developer/{p}-other", UNCLEAR, None),
    ("cat head tail sed awk less more bat", "*", "inspection/exact-text", PASS, None),
    ("wc cksum md5sum sha1sum sha256sum sha512sum", "*", "inspection/count-or-digest", PASS, None),
    ("rg grep egrep fgrep ag ack", "*", "search/unsupported-form", PASS, None),
    ("curl wget http xh", "*", "network/response", PASS, None),
    ("jq yq xmlstarlet sqlite3 psql mysql", "*", "structured-or-query-output", PASS, None),
    ("echo printf pwd which type command", "*", "shell/exact-small-output", PASS, None),
    ("rm mv cp install mkdir rmdir touch chmod chown ln kill pkill", "*", "mutation/command", PASS, None),
    ("python python3 node deno ruby perl bash sh zsh fish", "*", "script/other", UNCLEAR, None),
]
#: Options of programs with subcommands that take a value of their own.
VALUED = {
    "docker": "-H --host -l --log-level --config -c --context --tlscacert --tlscert --tlskey", "podman": "--log-level --root --runroot --url --connection --identity",
    "kubectl": "-n --namespace --context --cluster --user --kubeconfig -s --server --token --as --as-group --request-timeout -v --v",
    "gh": "-R --repo --hostname", "git": "-C -c --git-dir --work-tree --namespace", "npm": "--prefix -w --workspace --loglevel --registry", "pnpm": "-C --dir --filter -F --prefix --reporter",
    "yarn": "--cwd --registry", "bun": "--cwd --config", "bazel": "--output_base --output_user_root --bazelrc", "buck": "--config -c", "buck2": "--config -c",
}


def rows() -> list[tuple[str, str, str, str, str | None, int]]:
    """(program, subcommand, family, class, reducer, place) for every program and subcommand of the table."""
    out = []
    for place, (programs, subs, family, kind, reducer) in enumerate(TABLE):
        out += [(p, s, family.replace("{p}", p), kind, reducer, place) for p in programs.split() for s in subs.split()]
    return out


def subcommand(argv: list[str]) -> str | None:
    """The first word that is neither an option nor an option's value; after ``run``, the script of a package manager."""
    valued, i = VALUED.get(argv[0], "").split(), 1
    while i < len(argv):
        w = argv[i]
        if w in valued:
            i += 2
        elif w.startswith("-"):
            i += 1
        elif w in ("run", "exec") and argv[0] in ("npm", "pnpm", "yarn", "bun") and i + 1 < len(argv):
            return argv[i + 1]
        else:
            return w
    return None


_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


def bare(argv: list[str]) -> list[str]:
    """The words without assignments and one wrapper in front, the program by its own name."""
    drop = lambda ws: ws[next((i for i, w in enumerate(ws) if not _ASSIGNMENT.match(w)), len(ws)) :]
    words = drop(argv)
    head, rest = (words[0], words[1:]) if words else ("", [])
    if head in ("env", "command", "exec"):
        words = rest[1:] if rest[:1] == ["--"] else rest
        words = drop(words) if head == "env" else words
    elif head == "time":
        words = rest
    elif head == "timeout" and rest:
        words = rest[1:]
    return [words[0].rpartition("/")[2], *words[1:]] if words else []


def assess(argv: list[str] | None) -> tuple[str, str, str | None]:
    """(family, class, reducer) of a command's words; None: a command that could not be read."""
    if argv is None:
        return "shell/unsupported-syntax", PASS, None
    argv = bare(argv)
    if not argv:
        return "shell/setup-or-wrapper", PASS, None
    program, sub = argv[0], subcommand(argv) or "-"
    fits = [r for r in rows() if r[0] == program and r[1] in (sub, "*")]
    if fits:
        return fits[0][2:5]
    return ("local-program/other" if program.startswith(".") else "command/other"), UNCLEAR, None


def named(words: DataFrame) -> DataFrame:
    """command, program, sub of rows (command, argv): without assignments and wrapper in front."""

    def run(batches):
        for b in batches:
            out = [(c, bare(list(a))) for c, a in zip(b["command"], b["argv"], strict=True)]
            yield pd.DataFrame([(c, a[0], subcommand(a)) for c, a in out if a], columns=["command", "program", "sub"])

    return words.select("command", "argv").mapInPandas(run, "command string, program string, sub string")


def families(spark: SparkSession, commands: DataFrame) -> DataFrame:
    """command, family, class, reducer of rows (command, program, sub): a join with the broadcast table, the first row that fits."""
    table = spark.createDataFrame(rows(), "program string, s string, family string, class string, reducer string, place int")
    c = commands.withColumn("sub", F.coalesce("sub", F.lit("-")))
    best = c.join(F.broadcast(table), "program").where("s = sub or s = '*'").groupBy("command").agg(F.min_by(F.struct("family", "class", "reducer"), "place").alias("f"))
    other = F.when(F.col("program").startswith("."), "local-program/other").otherwise("command/other")
    return c.join(best, "command", "left").select("command", F.coalesce("f.family", other).alias("family"), F.coalesce("f.class", F.lit(UNCLEAR)).alias("class"), F.col("f.reducer").alias("reducer"))
