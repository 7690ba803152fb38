"""A corpus of tool calls projected from the driver's tables, by integer arithmetic and joins only.

Commands, tools, errors, conflicts, orphans and gaps all follow from doc_id, so that any engine that
runs the text below sees the same corpus.
"""

from __future__ import annotations

from tallyloom.functions.dialect import Spark

COMMANDS = [
    "rg needle src", "grep -rn error logs", "git status", "git diff HEAD~1", "git log --oneline -5", "cargo test --all", "cargo build",
    "pytest -q tests", "npm run build", "pnpm lint", "ls -la", "find . -name x", "git status --porcelain", "rg --json needle", "cargo test --message-format json",
    "docker logs web", "kubectl get pods", "kubectl get pods -o yaml", "journalctl -u web", "systemctl status web", "cat notes.txt", "sed -n 1p notes.txt",
    "python run.py", "curl -s host/path", "jq .name data.json", "make test", "ninja", "git grep -n word", "gh pr list", "gh pr list --json id",
    "tsc -p .", "eslint .", "uv run pytest", "go test ./...", "ps aux", "df -h", "echo done", "rm -rf build", "codex exec review", "tree -J src",
    "cargo test && git status", "cd src && cargo test --all", "rg needle | head -5", "FOO=1 make test", "timeout 60 pytest -q", "git log -1; git status", "cargo build || cargo test",
    "set -o pipefail && rg needle | tail -3", "cat notes.txt | wc -l", "git status > out.txt", "for f in a b; do cargo test; done", "./run.sh all", "bazel test all",
]
EXTRA_LINES = ["error: it broke", "warning: look here", "test result: ok. 3 passed", "all is well", "  On branch main", "2024-01-02 ERROR disk", "npm error code 1"]


def ctes(d: Spark) -> str:
    """calls, results, sessions, observations and issues as common table expressions over documents and labels."""
    values = lambda xs: ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs))
    return f"""
commands as (select k, command from (values {values(COMMANDS)}) as t(k, command)),
extras as (select k, extra from (values {values(EXTRA_LINES)}) as t(k, extra)),
sessions as (select distinct source || '/' || lang as session_key, lang as agent from documents),
all_calls as (select doc_id, cast(doc_id as string) as call_key, source || '/' || lang as session_key, lang as agent,
  case doc_id % 4 when 0 then 'exec_command' when 1 then 'Bash' when 2 then 'read' else 'run_terminal_cmd' end as tool_name,
  case when doc_id % 2 = 0 then 'json' else 'text' end as input_format,
  case when doc_id % 2 = 1 then command when doc_id % 14 = 0 then '{{"cmd":"' || command || '"}}' when doc_id % 22 = 0 then '{{"command":3,"cmd":"x"}}'
    when doc_id % 26 = 0 then '{{broken' else '{{"command":"' || command || '"}}' end as input_text
  from documents join commands on k = doc_id % {len(COMMANDS)}),
tool_calls as (select * from all_calls where doc_id % 83 <> 0),
first_results as (select doc_id, cast(doc_id as string) as call_key, toxic = 1 as is_error,
  text || chr(10) || extra || case when doc_id % 2 = 0 then chr(10) else '' end as output_text,
  case when doc_id % 9 = 0 then '{{"exit_code":' || cast(quality as string) || '}}' when doc_id % 9 = 3 then '{{"details":{{"exitCode":2}},"n":1}}'
    when doc_id % 9 = 5 then '{{"status":"failed"}}' when doc_id % 9 = 7 then '{{"exit_code":"0"}}'
    when doc_id % 9 = 2 then '{{"details":{{"truncation":{{"truncated":' || case when doc_id % 2 = 0 then 'true' else 'false' end || '}}}}}}'
    when doc_id % 9 = 4 then '{{"note":"' || chr(92) || '"truncated' || chr(92) || '":true","details":{{"details":{{"exit_code":3}}}}}}' end as output_json
  from documents left join (select doc_id as label_id, max(toxic) as toxic, max(quality) as quality from labels group by doc_id) l on doc_id = label_id
  join extras on k = doc_id % {len(EXTRA_LINES)} where doc_id % 89 <> 0),
tool_results as (select doc_id, call_key, is_error, output_text, output_json, call_key || '/0' as result_key from first_results
  union all select doc_id, call_key, is_error, output_text || ' again', output_json, call_key || '/1' from first_results where doc_id % 97 = 0),
observations as (select 'src' || cast(doc_id % 20 as string) as source_item_key, call_key, cast(null as string) as result_key, doc_id % 500 as line_number from all_calls
  union all select 'src' || cast(doc_id % 20 as string), null, result_key, doc_id % 500 + 1 from tool_results),
import_issues as (select 'issue/' || cast(doc_id as string) as issue_key, 'src' || cast((doc_id + 83) % 20 as string) as source_item_key,
  case when doc_id % 3 = 0 then 'error' else 'warning' end as severity, 'malformed_jsonl' as code, (doc_id + 83) % 500 as line_number,
  doc_id % 5 + 1 as occurrence_count from documents where doc_id % 11 = 0 or doc_id % 166 = 0)"""
