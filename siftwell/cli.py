"""Command line: scan, redact, hook and init.

Exit codes of a scan: 2 if something could not be read, else 1 with findings, else 0;
of a redaction: 1 if a dry run would change something, 2 if a file was refused or
findings remain, else 0. Errors are 2.
"""

from __future__ import annotations

import argparse
import shlex
import subprocess
import sys
from collections import defaultdict
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftwell.engine import Engine, Scanned
from siftwell.model import CATEGORIES, CONFIG_NAME, SAMPLE, load_config
from siftwell.operators.redact import UnsafeRedaction
from siftwell.operators.report import VERSION
from siftwell.sources.rewrite import rewrite
from siftwell.sources.secrets import read_values

HOOK_SIGN = "# written by siftwell"


def session() -> SparkSession:
    spark = SparkSession.builder.master("local[*]").appName("siftwell").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell", description="Find and mask secrets, personal data and internal names.")
    top.add_argument("--version", action="version", version=f"siftwell {VERSION}")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("paths", nargs="+", help="files or folders; '-' scans standard input")
    shared.add_argument("--config", help=f"configuration file (else the nearest {CONFIG_NAME})")
    for flag in ("--known-secrets", "--engine", "--category"):
        shared.add_argument(flag, action="append", default=[], choices=CATEGORIES if flag == "--category" else None)
    for flag in ("--allow-missing-engines", "--ocr", "--allow-unscanned"):
        shared.add_argument(flag, action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", parents=[shared], help="report findings")
    scan.add_argument("--format", choices=("json", "sarif", "text"), default="text")
    scan.add_argument("--history", action="store_true", help="paths are repositories; scan what their commits added")
    scan.add_argument("--rev", help="with --history: revisions as git takes them")
    change = commands.add_parser("redact", parents=[shared], help="replace findings in files; a dry run without --apply")
    change.add_argument("--apply", action="store_true")
    change.add_argument("--backup", action="store_true")
    hook = commands.add_parser("hook", help="install a hook that scans what a push adds")
    hook.add_argument("action", choices=("install",))
    hook.add_argument("repo", nargs="?", default=".")
    hook.add_argument("--force", action="store_true")
    hook.add_argument("--remote", action="append", default=[])
    hook.add_argument("--scan-args", default="")
    init = commands.add_parser("init", help="write a sample configuration")
    init.add_argument("dir", nargs="?", default=".")
    return top


def engine(args: argparse.Namespace) -> Engine:
    config = load_config("." if args.paths[0] == "-" else args.paths[0], args.config)
    values = [v for f in args.known_secrets for v in read_values(f)]
    config = replace(config, known_values=(*config.known_values, *values), engines=tuple(sorted({*config.engines, *args.engine})), categories=tuple(args.category) or config.categories)
    made = Engine(session(), config, args.ocr)
    if made.unavailable and not args.allow_missing_engines:
        raise SystemExit(f"siftwell: engines not installed: {', '.join(made.unavailable)} (--allow-missing-engines goes on without)")
    return made


def scan(args: argparse.Namespace) -> int:
    made = engine(args)
    if args.paths == ["-"]:
        found = made.scan_text(sys.stdin.read())
        none = made.spark.createDataFrame([], "path string, reason string")
        scanned = Scanned(found, none, none.select("path"), 1)
    elif args.history:
        each = [made.scan_history(repo, args.rev) for repo in args.paths]
        union = lambda name: reduce(DataFrame.unionByName, (getattr(x, name) for x in each))
        scanned = Scanned(union("findings"), union("unscanned"), union("images"), sum(x.files for x in each))
    else:
        scanned = made.scan_paths(args.paths)
    scanned.findings, scanned.unscanned = scanned.findings.cache(), scanned.unscanned.cache()
    try:
        print(made.report(scanned, args.format))
        if not args.allow_unscanned and (n := scanned.unscanned.count()):
            print(f"siftwell: {n} file(s) could not be read (--allow-unscanned accepts that)", file=sys.stderr)
            return 2
        return int(not scanned.findings.isEmpty())
    finally:  # a later scan of the same paths must read them again
        scanned.findings.unpersist()
        scanned.unscanned.unpersist()


def redact(args: argparse.Namespace) -> int:
    made = engine(args)
    by_file, inside = defaultdict(list), set()
    scanned = made.scan_paths(args.paths)
    for r in scanned.findings.collect():
        if r["where"]:
            inside.add(r["path"])
        else:
            by_file[r["path"]].append(tuple(r[c] for c in ("line", "start", "end", "category", "rule", "value")))
    for path in sorted(inside):
        print(f"findings inside {path} stay: change them where it was made", file=sys.stderr)
    refused = 0
    for path, spans in sorted(by_file.items()):
        try:
            print(f"{'redacted' if args.apply else 'would redact'} {rewrite(path, spans, args.backup) if args.apply else len(spans)} in {path}")
        except (UnsafeRedaction, UnicodeDecodeError) as e:
            refused += 1
            print(f"SKIPPED {path}: {e}", file=sys.stderr)
    total = sum(map(len, by_file.values()))
    print(f"{total} span(s) in {len(by_file)} of {scanned.files} file(s), {refused} refused")
    if not args.apply:
        return int(total > 0)
    left = made.scan_paths(sorted(by_file)).findings.where("where = ''").count() if by_file else 0
    print(f"{left} finding(s) left")
    return 2 if refused or left else 0


def hook_text(remotes: list[str], scan_args: list[str]) -> str:
    """A pre-push hook: what each pushed branch has that the remote has not is scanned."""
    root = shlex.quote(str(Path(__file__).resolve().parents[1]))
    call = f"PYTHONPATH={root} " + shlex.join([sys.executable, "-m", "siftwell", "scan", "--history", *scan_args])
    only = f'case "$1" in {"|".join(remotes)}) ;; *) exit 0 ;; esac\n' if remotes else ""
    return f"""#!/bin/sh
{HOOK_SIGN}; git push --no-verify goes around it
{only}failed=0
while read -r _ new _ old; do
  case "$new" in *[!0]*) ;; *) continue ;; esac
  case "$old" in *[!0]*) range="$old..$new" ;; *) range="$new --not --remotes=$1" ;; esac
  {call} --rev "$range" . || failed=1
done
exit $failed
"""


def hook(args: argparse.Namespace) -> int:
    if any(not r or not set(r) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_.") for r in args.remote):
        raise ValueError("a remote's name has letters, digits, '-', '_' and '.' only")
    done = subprocess.run(["git", "-C", args.repo, "rev-parse", "--git-path", "hooks"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{args.repo} is no git repository")
    path = Path(args.repo, done.stdout.strip(), "pre-push")
    if path.exists() and not args.force and HOOK_SIGN not in path.read_text("utf-8", "replace"):
        raise RuntimeError(f"{path} is someone else's hook (--force replaces it)")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(hook_text(args.remote, shlex.split(args.scan_args)), "utf-8")
    path.chmod(0o755)
    print(f"wrote {path}")
    return 0


def init(args: argparse.Namespace) -> int:
    path = Path(args.dir, CONFIG_NAME)
    try:
        with path.open("x", encoding="utf-8") as f:
            f.write(SAMPLE)
    except FileExistsError:
        print(f"{path} is there already", file=sys.stderr)
        return 2
    print(f"wrote {path}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"scan": scan, "redact": redact, "hook": hook, "init": init}[args.command](args)
    except Exception as e:  # whatever it is, nothing was cleared
        print(f"siftwell: {type(e).__name__}: {e}", file=sys.stderr)
        return 2
