"""The built-in rule pack: the rules that reduce, one row each, the line transforms, and guards by program.

Fixed values: ids, programs, words and limits. A guard's id is its label and its option's name, which
is the option without dashes and in lower case unless the row gives another.
"""

from __future__ import annotations

import re

#: (id, programs, words that must follow, reducer)
REDUCE = [
    ("build/cmake", "cmake", "--build", "build"), ("build/cmake-preset", "cmake", "--preset", "build"), ("build/cmake-source", "cmake", "-S", "build"),
    ("build/gradle-build", "gradle", "build", "build"), ("build/gradle-check", "gradle", "check", "build"), ("build/gradle-test", "gradle", "test", "test"),
    ("build/maven-package", "mvn", "package", "build"), ("build/maven-test", "mvn", "test", "test"), ("build/maven-verify", "mvn", "verify", "build"),
    ("build/ninja", "ninja", "", "build"), ("build/slophammer-go-check", "slophammer-go", "check", "build"), ("build/slophammer-rs-check", "slophammer-rs", "check", "build"),
    ("build/task-build", "make just", "build", "build"), ("build/task-check", "make just", "check", "build"), ("build/task-lint", "make just", "lint", "build"), ("build/task-test", "make just", "test", "test"),
    ("dotnet/build", "dotnet", "build", "build"), ("dotnet/test", "dotnet", "test", "test"),
    ("filesystem/df", "df", "", "list"), ("filesystem/du", "du", "", "list"), ("filesystem/fd", "fd fdfind", "", "list"), ("filesystem/find", "find", "", "list"), ("filesystem/ls", "ls", "", "list"), ("filesystem/tree", "tree", "", "list"),
    ("gh/issue-list", "gh", "issue list", "list"), ("gh/issue-status", "gh", "issue status", "status"), ("gh/issue-view", "gh", "issue view", "status"),
    ("gh/pr-checks", "gh", "pr checks", "status"), ("gh/pr-diff", "gh", "pr diff", "diff"), ("gh/pr-list", "gh", "pr list", "list"), ("gh/pr-status", "gh", "pr status", "status"), ("gh/pr-view", "gh", "pr view", "status"),
    ("gh/release-list", "gh", "release list", "list"), ("gh/release-view", "gh", "release view", "status"), ("gh/repo-list", "gh", "repo list", "list"), ("gh/repo-view", "gh", "repo view", "list"),
    ("gh/run-list", "gh", "run list", "list"), ("gh/run-view", "gh", "run view", "status"),
    ("gh/search-code", "gh", "search code", "search"), ("gh/search-issues", "gh", "search issues", "search"), ("gh/search-prs", "gh", "search prs", "search"), ("gh/search-repos", "gh", "search repos", "search"),
    ("gh/workflow-list", "gh", "workflow list", "list"), ("gh/workflow-view", "gh", "workflow view", "status"),
    ("git/branch-all", "git", "branch -a", "list"), ("git/branch-list", "git", "branch --list", "list"), ("git/branch-verbose", "git", "branch -vv", "list"),
    ("git/diff", "git", "diff", "diff"), ("git/log-oneline", "git", "log --oneline", "list"), ("git/reflog", "git", "reflog", "log"),
    ("git/remote-show", "git", "remote show", "list"), ("git/remote-verbose", "git", "remote -v", "list"), ("git/remote-verbose-long", "git", "remote --verbose", "list"),
    ("git/stash-list", "git", "stash list", "log"), ("git/status", "git", "status", "status"), ("git/tag-list", "git", "tag --list", "list"), ("git/tag-list-short", "git", "tag -l", "list"), ("git/worktree-list", "git", "worktree list", "list"),
    ("go/build", "go", "build", "build"), ("go/test", "go", "test", "test"), ("go/vet", "go", "vet", "build"),
    ("herdr/pane-list", "herdr", "pane list", "list"), ("herdr/tab-list", "herdr", "tab list", "list"), ("herdr/workspace-list", "herdr", "workspace list", "list"),
    ("hf/jobs-logs", "hf", "jobs logs", "log"), ("hf/spaces-logs", "hf", "spaces logs", "log"),
    ("js/build-alias", "npm pnpm yarn bun", "build", "build"), ("js/check-alias", "npm pnpm yarn bun", "check", "build"), ("js/eslint", "eslint", "", "build"), ("js/lint-alias", "pnpm yarn bun", "lint", "build"),
    ("js/npx-eslint", "npx", "eslint", "build"), ("js/npx-prettier-check", "npx", "prettier --check", "build"), ("js/npx-vitest", "npx", "vitest", "test"),
    ("js/pnpm-oxlint", "pnpm", "exec oxlint", "build"), ("js/pnpm-prettier-check", "pnpm", "exec prettier --check", "build"), ("js/pnpm-vitest", "pnpm", "exec vitest", "test"), ("js/pnpm-vitest-shorthand", "pnpm", "vitest run", "test"),
    ("js/run-build", "npm pnpm yarn bun", "run build", "build"), ("js/run-check", "npm pnpm yarn bun", "run check", "build"), ("js/run-coverage", "npm pnpm yarn bun", "run coverage", "test"), ("js/run-docs-check", "npm pnpm yarn bun", "run docs:check", "build"),
    ("js/run-format-check", "npm pnpm yarn bun", "run format:check", "build"), ("js/run-lint", "npm pnpm yarn bun", "run lint", "build"), ("js/run-slophammer", "npm pnpm yarn bun", "run slophammer", "build"),
    ("js/run-test", "npm pnpm yarn bun", "run test", "test"), ("js/run-typecheck", "npm pnpm yarn bun", "run typecheck", "build"), ("js/test", "npm pnpm yarn bun", "test", "test"), ("js/tsc", "tsc", "", "build"), ("js/typecheck-alias", "pnpm yarn bun", "typecheck", "build"),
    ("ops/container-images", "docker podman", "images", "list"), ("ops/container-ps", "docker podman", "ps", "list"), ("ops/docker-build", "docker podman", "build", "build"), ("ops/docker-buildx", "docker podman", "buildx build", "build"),
    ("ops/docker-logs", "docker podman", "logs", "log"), ("ops/docker-stats", "docker podman", "stats --no-stream", "status"), ("ops/journalctl", "journalctl", "", "log"),
    ("ops/kubectl-describe", "kubectl", "describe", "status"), ("ops/kubectl-events", "kubectl", "events", "log"), ("ops/kubectl-get", "kubectl", "get", "list"), ("ops/kubectl-logs", "kubectl", "logs", "log"), ("ops/kubectl-top", "kubectl", "top", "list"),
    ("ops/systemctl-status", "systemctl", "status", "status"), ("ops/systemctl-user-status", "systemctl", "--user status", "status"),
    ("python/module-pytest", "python python3", "-m pytest", "test"), ("python/mypy", "mypy", "", "build"), ("python/pyright", "pyright", "", "build"), ("python/pytest", "pytest", "", "test"),
    ("python/ruff", "ruff", "check", "build"), ("python/uv-pytest", "uv", "run pytest", "test"), ("python/uv-ruff", "uv", "run ruff", "build"), ("reviews/codex-review", "codex", "", "log"),
    ("rust/cargo-audit", "cargo", "audit", "build"), ("rust/cargo-build", "cargo", "build", "build"), ("rust/cargo-check", "cargo", "check", "build"), ("rust/cargo-clippy", "cargo", "clippy", "build"), ("rust/cargo-coverage", "cargo", "llvm-cov", "test"), ("rust/cargo-test", "cargo", "test", "test"),
    ("search/git-grep", "git", "grep", "search"), ("search/grep", "grep egrep fgrep", "", "search"), ("search/rg", "rg", "", "search"),
    ("system/free", "free", "", "status"), ("system/lsof", "lsof", "", "list"), ("system/ps-all", "ps", "-e", "list"), ("system/ps-aux", "ps", "aux", "list"), ("system/ps-ef", "ps", "-ef", "list"),
]
#: A word that must occur besides.
NEEDED = {"reviews/codex-review": "review"}
# Limits: the longest line of a successful result by reducer and of some rules, of a failed one, and the least saving.
LINE = {"build": 16384, "test": 16384, "list": 32768, "log": 32768, "search": 32768, "diff": 32768, "status": 32768}
LINE_OF = {"gh/pr-checks": 16384, "git/status": 16384, "herdr/pane-list": 16384, "herdr/tab-list": 16384, "herdr/workspace-list": 16384}
FAILURE_LINE, FAILURE_LINE_OF = 32768, {"git/status": 16384}
LEAST, LEAST_MORE = 256, 512
SAVES_MORE = (
    "gh/pr-diff", "gh/run-view", "git/diff", "hf/jobs-logs", "hf/spaces-logs", "ops/docker-logs", "ops/journalctl", "ops/kubectl-events", "ops/kubectl-logs",
    "ops/systemctl-status", "ops/systemctl-user-status", "reviews/codex-review",
)
TRANSFORM = ("cat", "head", "sort", "tail", "tee", "uniq")


def _both(name: str, short: str) -> dict[str, str]:
    return {f"--{name}": f"{name}-long", short: f"{name}-short"}


_FILES = {"-c": "short-count", "-l": "short-files", "-L": "short-files-without"}
#: (label, programs, words that must follow, options: each makes a rule of its own; None: the rule needs no option)
GUARDS: list[tuple[str, str, str, str | dict[str, str] | None]] = [
    ("cargo", "cargo", "", "--cobertura --codecov --json --lcov --message-format"),
    ("cargo-test", "cargo", "test", "--format"),
    ("cat", "cat", "", {"--number": "number-long", "-b": "number-nonblank", "-n": "number", "--show-all": "show-all-long", "-A": "show-all", "-s": "squeeze"}),
    ("cmake", "cmake", "", "--debug-find --debug-output --trace --trace-expand --trace-redirect --trace-source"),
    ("codex", "codex", "", "--json"),
    ("container", "docker podman", "", _both("quiet", "-q")),
    ("df", "df", "", "--output"),
    ("docker", "docker podman", "", "--format --progress"),
    ("du", "du", "", _both("null", "-0")),
    ("eslint", "eslint", "", _both("format", "-f")),
    ("eslint", "eslint", "", "--inspect-config --print-config"),
    ("fd", "fd fdfind", "", _both("exec-batch", "-X") | _both("exec", "-x") | _both("print0", "-0")),
    ("find", "find", "", "-delete -exec -execdir -fls -fprint -fprint0 -fprintf -ok -okdir -print0 -printf"),
    ("free", "free", "", _both("count", "-c") | _both("seconds", "-s")),
    ("gh", "gh", "", "--json --template --yaml"),
    ("git-branch", "git", "branch", {"--format": "format", "--null": "null", "-z": "zero"}),
    ("git-diff", "git", "diff", "--binary --dirstat --name-only --name-status --null --numstat --patch-with-raw --raw --shortstat --stat --word-diff"),
    ("git-diff", "git", "diff", {"-z": "zero"}),
    ("git-grep", "git", "grep", "--count --files-with-matches --files-without-match --null"),
    ("git-grep", "git", "grep", _FILES | {"-z": "zero"}),
    ("git-log", "git", "log", {"--format": "format", "--null": "null", "--pretty": "pretty", "-z": "zero"}),
    ("git", "git", "", {"--null": "null-all", "--porcelain": "porcelain", "-z": "zero-all"}),
    ("git-reflog-delete", "git", "reflog delete", None),
    ("git-reflog-drop", "git", "reflog drop", None),
    ("git-reflog-exists", "git", "reflog exists", None),
    ("git-reflog-expire", "git", "reflog expire", None),
    ("git-reflog-write", "git", "reflog write", None),
    ("git-reflog", "git", "reflog", "--format --pretty"),
    ("git-show", "git", "show", None),
    ("git-stash", "git", "stash list", "--format --pretty"),
    ("git-status", "git", "status", {"-z": "nul", "--porcelain": "porcelain"}),
    ("git-tag", "git", "tag", "--format"),
    ("go", "go", "", "-json"),
    ("go-test", "go", "test", "-json"),
    ("grep", "grep egrep fgrep", "", "--count --files-with-matches --files-without-match --null --null-data"),
    ("grep", "grep egrep fgrep", "", _FILES | {"-Z": "capital-z", "-z": "zero-data"}),
    ("head-tail", "head tail", "", {"--bytes": "bytes-long", "-c": "bytes", "--verbose": "verbose-long", "-v": "verbose"}),
    ("hf", "hf", "", _both("follow", "-f") | _both("quiet", "-q")),
    ("hf", "hf", "", {"--json": "json", "--format json": "format-json", "--format=json": "format-json-equals", "--format quiet": "format-quiet", "--format=quiet": "format-quiet-equals"}),
    ("journal", "journalctl", "", _both("output", "-o")),
    ("journal", "journalctl", "", "--output-fields"),
    ("kubectl", "kubectl", "", _both("output", "-o")),
    ("kubectl", "kubectl", "", {"-w": "short-watch", "--watch": "watch"}),
    ("line-transform", "head tail sort uniq", "", {"--zero-terminated": "zero-long", "-z": "zero"}),
    ("log-follow", "journalctl docker podman kubectl", "", {"--follow": "follow", "-f": "short-follow"}),
    ("ls", "ls", "", {"--dired": "dired", "-D": "dired-short", "--zero": "zero"}),
    ("lsof", "lsof", "", {"-F": "fields", "+r": "repeat-plus", "-r": "repeat-short", "-t": "terse"}),
    ("mypy", "mypy", "", {"--output": "output", "-O": "short-output"}),
    ("ninja", "ninja", "", {"-t": "tool"}),
    ("npx-eslint", "npx", "eslint", _both("format", "-f")),
    ("npx-eslint", "npx", "eslint", "--inspect-config --print-config"),
    ("package", "npm pnpm yarn bun", "", "--json"),
    ("package", "npm pnpm yarn bun npx", "", {"--reporter": "reporter", "--watch": "watch", "--watchAll": "watch-all", "--watch-all": "watch-dash"}),
    ("pipeline", "cat tee head tail sort uniq", "", "--help --version"),
    ("pnpm-oxlint", "pnpm", "exec oxlint", _both("format", "-f")),
    ("ps", "ps", "", {"O": "format-bsd-preloaded", "o": "format-bsd", "--format": "format-long", "-O": "format-preloaded", "-o": "format-short"}),
    ("pyright", "pyright", "", {"--outputjson": "json"}),
    ("pytest", "pytest", "", "--collect-only --json-report"),
    ("python-pytest", "python python3", "-m pytest", "--collect-only --json-report"),
    ("rg", "rg", "", "--count --count-matches --files --files-with-matches --files-without-match --json --null --type-list"),
    ("rg", "rg", "", _FILES | {"-0": "zero"}),
    ("ruff", "ruff", "check", "--output-format --show-files --show-settings"),
    ("sort", "sort", "", {"--debug": "debug", "--output": "output-long", "-o": "output"}),
    ("systemctl", "systemctl", "", _both("output", "-o")),
    ("tail", "tail", "", {"-F": "follow-capital", "--follow": "follow-long", "-f": "follow"}),
    ("tree", "tree", "", {"-H": "html", "-J": "json", "-o": "output", "-X": "xml"}),
    ("tsc", "tsc", "", "--explainFiles --generateTrace --listFiles --listFilesOnly --showConfig --traceResolution"),
    ("uniq", "uniq", "", {"--count": "count-long", "-c": "count", "--group": "group"}),
    ("uv-pytest", "uv", "run pytest", "--collect-only --json-report"),
    ("uv-ruff", "uv", "run ruff", "--output-format --show-files --show-settings"),
]
#: A guard outside the guards' own folder: (id, programs, words that must follow).
WATCH = ("gh/run-watch", "gh", "run watch")
# Global options of programs that take a value, and those that take none.
OPTIONS_WITH_VALUE = {
    "git": ("-C", "-c", "--git-dir", "--work-tree"), "npm": ("--prefix", "-w", "--workspace"), "pnpm": ("-C", "--dir", "--filter"),
    "yarn": ("-C", "--dir", "--filter"), "bun": ("-C", "--dir", "--filter"), "uv": ("--project",), "gh": ("-R", "--repo"),
}
_PACKAGE = ("--dir=", "--filter=", "-r", "--recursive", "-w", "--workspace-root", "--parallel", "--stream", "--aggregate-output", "-s", "--silent")
OPTIONS_ALONE = {
    "git": ("--git-dir=", "--work-tree=", "--no-pager", "--paginate", "--literal-pathspecs", "--glob-pathspecs", "--noglob-pathspecs"),
    "npm": ("--prefix=", "--workspace=", "--workspaces", "-ws", "-s", "--silent"),
    "pnpm": _PACKAGE, "yarn": _PACKAGE, "bun": _PACKAGE, "uv": ("--project=",), "gh": ("--repo=",),
}


def option_name(option: str) -> str:
    """An option without dashes in front, words by dashes."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", option.lstrip("-")).lower()


def rules() -> list[dict]:
    """The rules: id, action, programs, argv_prefix, contains, reducer and limits."""
    made = lambda i, action, programs, prefix, contains=(), **more: {"id": i, "action": action, "programs": programs.split(), "argv_prefix": prefix.split(), "contains": list(contains)} | more
    none = {"reducer": None, "line_bytes": 0, "failure_line_bytes": 0, "least": 0}
    out = []
    for i, programs, prefix, reducer in REDUCE:
        limits = {"line_bytes": LINE_OF.get(i, LINE[reducer]), "failure_line_bytes": FAILURE_LINE_OF.get(i, FAILURE_LINE), "least": LEAST_MORE if i in SAVES_MORE else LEAST}
        out.append(made(i, "reduce", programs, prefix, NEEDED.get(i, "").split(), reducer=f"{reducer}_summary", **limits))
    out += [made(f"pipeline/{p}", "transform", p, "", **none) for p in TRANSFORM]
    out.append(made(WATCH[0], "passthrough", *WATCH[1:], **none))
    for label, programs, prefix, options in GUARDS:
        if options is None:
            out.append(made(f"guards/{label}", "passthrough", programs, prefix, **none))
        else:
            named = options if isinstance(options, dict) else {o: option_name(o) for o in options.split()}
            out += [made(f"guards/{label}-{name}", "passthrough", programs, prefix, o.split(), **none) for o, name in named.items()]
    return out
