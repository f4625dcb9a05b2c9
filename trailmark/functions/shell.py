"""Shell texts as simple commands with what they do (T3 to T5): a recursive-descent reader of POSIX shell grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from here to MODULES: acts and effects, how grave an effect is, and what well-known programs do.
SEVERITY = {"none": 0, "workspace": 1, "environment": 2, "history": 3, "destructive": 4, "remote": 5, "unknown": 1}

#: act, effect and the first operand that is a path (- where none is) of programs; ``know`` adds others.
PROGRAMS = """
inspect none 0: basename cat cmp cut df diff dirname du fd file find head jq less ls md5sum more readlink realpath sha256sum sort stat strings tail tar tee tr tree uniq unzip wc xxd yq
inspect none 1: ag awk egrep fgrep grep perl rg sed xargs
inspect none -: [ [[ base64 date echo env expr false hostname id lsof man printenv printf ps pwd seq test top true type uname which whoami
edit workspace 0: cp gunzip gzip install ln mkdir mv patch touch zip
edit workspace 1: chmod chown
edit workspace -: mktemp
edit destructive 0: rm rmdir shred truncate
edit destructive -: dd
test none -: ctest jest mocha nox playwright pytest rspec tox unittest vitest
build none -: eslint flake8 mypy pylint pyright ruff shellcheck tsc
build workspace -: ant bazel black cargo clang cmake g++ gcc go gradle isort javac just make mvn ninja pandoc prettier rustc tsx vite webpack
install environment -: apk apt apt-get brew bun bundle conda dnf gem mise npm pip pip3 pipx pnpm rustup yarn yum
run unknown -: bash deno docker hatch java mysql node npx pdm php poetry psql python python3 ruby sh sqlite3 uv uvicorn uvx zsh
network none -: curl dig gh nc ping wget
network unknown -: aws az gcloud helm kubectl ssh terraform
network remote -: heroku netlify scp sftp vercel
network workspace 0: rsync
process none -: bg fg sleep timeout tmux wait watch
process environment -: kill killall pkill systemctl
shell none -: . : alias break cd command continue declare eval exec exit export local nice nohup popd pushd read return set shift source sudo time trap umask unset
vcs none -: git
vcs unknown -: hg svn
"""

#: The same by subcommand; names of several programs are parted by a bar.
SUBCOMMANDS = """
git: vcs none: archive blame cat-file config describe diff fetch format-patch grep help log ls-files ls-remote ls-tree merge-base reflog remote rev-list rev-parse shortlog show status version
git: vcs workspace: add apply bisect branch checkout clone init mv stash submodule switch worktree
git: vcs history: am cherry-pick commit merge notes pull rebase reset revert tag
git: vcs destructive: clean filter-branch gc restore rm
git: vcs remote: push
gh: network none: api browse issue pr release repo run search workflow
gh: network environment: auth
gh issue|gh pr: network none: checks diff list status view
gh issue|gh pr: network remote: close comment create delete edit merge ready reopen review
gh pr|gh repo: vcs workspace: checkout clone
gh release|gh repo|gh run|gh workflow: network none: download list view watch
gh release|gh repo|gh run|gh workflow: network remote: cancel create delete disable edit enable fork rerun run sync upload
bun|npm|pnpm|yarn: install environment: add ci i install link remove rm un uninstall up update upgrade
bun|npm|pnpm|yarn: test none: t test
bun|npm|pnpm|yarn: build workspace: build
bun|npm|pnpm|yarn: build none: lint
bun|npm|pnpm|yarn: inspect none: audit info list ls outdated view why
bun|npm|pnpm|yarn: run unknown: dlx exec run x
bun|npm|pnpm|yarn: edit workspace: init
bun|npm|pnpm|yarn: network remote: publish
bun run|npm run|pnpm run|yarn run: test none: test
bun run|npm run|pnpm run|yarn run: build workspace: build format
bun run|npm run|pnpm run|yarn run: build none: check lint typecheck
cargo: install environment: add install remove rm update
cargo: test none: nextest test
cargo: build workspace: build check clippy doc fmt
cargo: run unknown: bench run
cargo: inspect none: metadata search tree
cargo: network remote: publish
go: install environment: get install mod
go: test none: test
go: build workspace: build fmt generate vet
go: run unknown: run
go: inspect none: doc env list version
uv: install environment: add lock pip python remove sync tool venv
uv: build workspace: build
uv: inspect none: tree
uv: network remote: publish
uv: run unknown: run
docker: inspect none: images inspect logs ps
docker: build environment: build
docker: run environment: compose run
docker: run unknown: exec
docker: network remote: push
docker: install environment: pull
docker: process destructive: rm rmi system
docker: process environment: kill stop
just|make: test none: check test
just|make: build none: lint
just: build workspace: build fmt
make: edit destructive: clean
make: install environment: install
mise: run unknown: exec run x
mise: inspect none: current ls which
"""

#: Flags that take a value, that force, and that make a command destructive or remote.
FLAGS = """
valued curl: --data --form --header --output --request -F -H -T -X -d -o -u
valued gh api: --input --method -F -X -f
valued git: --git-dir --work-tree -C -c
valued git branch: --set-upstream-to -u
valued git commit: --file --message -C -F -c -m
valued git push: --push-option -o
valued git tag: -m
valued python|python3: -c -m
forced cp|ln|mv|rm: --force -f
forced git checkout|git clean: --force -f
forced git commit: --amend --no-verify -n
forced git pull: --force -f
forced git push: --delete --force --force-with-lease -d -f
forced git rebase: --autosquash -i
forced git reset: --hard
destructive git branch: --delete -D -M -d -m
destructive git checkout: -- --force -f .
destructive git push: --delete --force -d -f
destructive git reset: --hard
destructive git switch: --discard-changes -f
destructive git tag: -d
destructive git worktree: prune remove
destructive rsync: --delete
remote curl: --data --data-binary --data-raw --form --request --upload-file -F -T -X -d
remote gh api: --input --method -F -X -f
"""

#: Programs that run the command after them: options of theirs that take a value, and how many other values they take.
WRAPPERS = {"builtin": ((), 0), "command": ((), 0), "doas": (("-u",), 0), "env": (("-u",), 0), "exec": ((), 0), "nice": (("-n",), 0), "nohup": ((), 0), "stdbuf": ((), 0), "sudo": (("-g", "-u"), 0), "time": ((), 0), "timeout": (("-k", "-s"), 1), "xargs": (("-I", "-L", "-P", "-n"), 0)}
#: Tools whose remaining words are the command they run.
RUNNERS = {"bundle exec", "bunx", "conda run", "hatch run", "mise exec", "mise x", "npm exec", "npx", "pdm run", "pipx run", "pnpm exec", "poetry run", "uv run", "uvx", "yarn exec"}
#: What ``python -m`` runs.
MODULES = """
test none: pytest unittest
build none: flake8 mypy ruff
build workspace: black build
install environment: pip venv
run none: http.server
inspect none: json.tool
network remote: twine
"""


@dataclass(frozen=True)
class Kind:
    act: str
    effect: str
    paths_from: int | None = None


def _kinds(table: str) -> dict[str, Kind]:
    found = {}
    for line in table.strip().splitlines():
        (act, effect, *place), names = line.split(":", 1)[0].split(), line.split(":", 1)[1].split()
        found |= {name: Kind(act, effect, int(place[0]) if place and place[0] != "-" else None) for name in names}
    return found


def _by_subcommand(table: str) -> dict[str, Kind]:
    found = {}
    for line in table.strip().splitlines():
        programs, kind, names = line.split(": ", 2)
        found |= {f"{program} {name}": Kind(*kind.split()) for program in programs.split("|") for name in names.split()}
    return found


def _by_flag(table: str) -> dict[tuple[str, str], frozenset[str]]:
    found = {}
    for line in table.strip().splitlines():
        head, flags = line.split(": ", 1)
        role, names = head.split(" ", 1)
        found |= {(role, name): frozenset(flags.split()) for name in names.split("|")}
    return found


_KNOWN = _kinds(PROGRAMS) | _by_subcommand(SUBCOMMANDS)
_ROLES = _by_flag(FLAGS)
_MODULES = _kinds(MODULES)


def _parents(names: dict[str, Kind]) -> set[str]:
    """What stands before a space in a name: programs and subcommands that have subcommands."""
    return {name[:at] for name in names for at, c in enumerate(name) if c == " "}


_PARENTS = _parents(_KNOWN)


def know(programs: str = "", subcommands: str = "", flags: str = "") -> None:
    """Adds programs, subcommands and flags, written like the tables above; what is there already is replaced."""
    added = _kinds(programs) | _by_subcommand(subcommands)
    _KNOWN.update(added)
    _PARENTS.update(_parents(added))
    _ROLES.update(_by_flag(flags))


_OPEN = {"if": "if", "while": "loop", "until": "loop", "for": "loop", "case": "case", "{": "group", "(": "subshell", "!": "not"}
_CLOSE = {"fi", "done", "esac", "}", ")"}
_MIDDLE = {"then", "else", "elif", "do"}


@dataclass
class Command:
    argv: list[str] = field(default_factory=list)
    assignments: list[str] = field(default_factory=list)
    redirects: list[tuple[str, str]] = field(default_factory=list)
    join: str = "first"
    nesting: tuple[str, ...] = ()
    background: bool = False
    program: str | None = None
    subcommand: str | None = None
    flags: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    operands: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    wrappers: list[str] = field(default_factory=list)
    act: str = "other"
    effect: str = "unknown"
    forced: bool = False
    known: bool = False


class ShellError(ValueError):
    pass


_REDIRECT = re.compile(r"\d*(<<<|<<-?|<>|<&|>&|&>>?|>>|>\||<|>)")
_OPERATOR = re.compile(r"&&|\|\||;;|\|&|[;&|()]")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*=")
#: Letters that stand for themselves, outside quotes and between double quotes.
_PLAIN, _QUOTED = re.compile(r"[^ \t\n;&|<>()\\'\"`$]+"), re.compile(r'[^"\\`$]+')


def _tokens(text: str) -> list[tuple[str, str, list[str]]]:
    """(kind, text, substituted commands) of words, operators and redirects; here-documents are skipped."""
    out: list[tuple[str, str, list[str]]] = []
    at, pending = 0, []
    while at < len(text):
        c = text[at]
        if c == "\n":
            at += 1
            for mark in pending:
                end = re.compile(rf"^\t*{re.escape(mark)}$", re.M).search(text, at)
                at = end.end() + 1 if end else len(text)
            pending = []
            out.append(("op", "\n", []))
        elif c in " \t":
            at += 1
        elif text.startswith("\\\n", at):
            at += 2
        elif c == "#" and (not out or text[at - 1] in " \t\n;"):
            end = text.find("\n", at)
            at = end if end >= 0 else len(text)
        elif (c in "<>&" or c.isdigit()) and (m := _REDIRECT.match(text, at)):
            at = m.end()
            while at < len(text) and text[at] in " \t":
                at += 1
            word, inner, at = _word(text, at)
            if m[1] in ("<<", "<<-"):
                pending.append(word)
            out.append(("redirect", m[1], [word, *inner]))
        elif m := _OPERATOR.match(text, at):
            out.append(("op", m[0], []))
            at = m.end()
        else:
            word, inner, at = _word(text, at)
            out.append(("word", word, inner))
    return out


def _word(text: str, at: int) -> tuple[str, list[str], int]:
    """A word with its quotes removed, the commands substituted in it, and where it ends."""
    made, inner, begin = [], [], at
    while at < len(text) and text[at] not in " \t\n;&|<>()":
        if m := _PLAIN.match(text, at):
            made.append(m[0])
            at = m.end()
            continue
        c = text[at]
        if c == "\\":
            made.append(text[at + 1 : at + 2])
            at += 2
        elif c == "'":
            end = text.find("'", at + 1)
            if end < 0:
                raise ShellError("a quote isn't closed")
            made.append(text[at + 1 : end])
            at = end + 1
        elif c == '"':
            at += 1
            while at < len(text) and text[at] != '"':
                if m := _QUOTED.match(text, at):
                    made.append(m[0])
                    at = m.end()
                elif text.startswith("$(", at) or text[at] == "`":
                    part, at = _substitution(text, at)
                    inner.append(part)
                    made.append("$()")
                elif text[at] == "\\" and text[at + 1 : at + 2] in '"\\$`':
                    made.append(text[at + 1 : at + 2])
                    at += 2
                else:
                    made.append(text[at])
                    at += 1
            if at >= len(text):
                raise ShellError("a quote isn't closed")
            at += 1
        elif text.startswith("$(", at) or c == "`":
            part, at = _substitution(text, at)
            inner.append(part)
            made.append("$()")
        elif text.startswith("${", at):
            end = text.find("}", at)
            if end < 0:
                raise ShellError("an expansion isn't closed")
            made.append(text[at : end + 1])
            at = end + 1
        else:
            made.append(c)
            at += 1
    if at == begin:
        raise ShellError(f"nothing to read at {at}")
    return "".join(made), inner, at


def _substitution(text: str, at: int) -> tuple[str, int]:
    if text[at] == "`":
        end = text.find("`", at + 1)
        if end < 0:
            raise ShellError("a substitution isn't closed")
        return text[at + 1 : end], end + 1
    depth, i, quote = 1, at + 2, ""
    while i < len(text) and depth:
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    if depth:
        raise ShellError("a substitution isn't closed")
    return text[at + 2 : i - 1], i


def parse(text: str, nesting: tuple[str, ...] = ()) -> list[Command]:
    """T4: the simple commands of a script in order; commands inside substitutions follow the one that holds them."""
    if len(text) > 200_000:
        raise ShellError("too long")
    out: list[Command] = []
    stack: list[str] = list(nesting)
    base = len(stack)
    join, now, after = "first", Command(), []
    pattern = 0  # in a case: words before the closing parenthesis of a pattern

    def close(next_join: str, background: bool = False) -> None:
        nonlocal now, after, join
        if now.argv or now.assignments or now.redirects:
            now.join, now.nesting, now.background = join, tuple(stack), background
            out.append(describe(now))
            for inner in after:
                out.extend(parse(inner, (*stack, "substitution")))
            if now.argv[:1] and now.argv[0] in ("sh", "bash") and "-c" in now.argv and now.argv.index("-c") + 1 < len(now.argv):
                out.extend(parse(now.argv[now.argv.index("-c") + 1], (*stack, "script")))
        now, after, join = Command(), [], next_join

    for kind, word, more in _tokens(text):
        if kind == "redirect":
            now.redirects.append((word, more[0]))
            after += more[1:]
        elif kind == "op":
            if word == "(":
                if now.argv and len(now.argv) == 1:
                    stack.append("function")
                    now = Command()
                elif not pattern:
                    stack.append("subshell")
            elif word == ")":
                if pattern:
                    pattern, now, after = 0, Command(), []
                elif stack[base:] and stack[-1] == "function":
                    stack.pop()
                elif stack[base:] and stack[-1] == "subshell":
                    close("seq")
                    stack.pop()
                else:
                    raise ShellError("a parenthesis too many")
            elif word == ";;":
                close("seq")
                pattern = 1
            elif pattern and word == "|":
                now = Command()
            else:
                close({"&&": "and", "||": "or", "|": "pipe", "|&": "pipe"}.get(word, "seq"), word == "&")
        elif pattern:
            if word == "esac":
                pattern = 0
                stack.pop()
        elif not now.argv and not now.assignments and word in _OPEN and word != "(":
            stack.append(_OPEN[word])
            if word in ("for", "case"):
                now.argv = [word]
        elif now.argv[:1] == ["case"] and word == "in":
            now, pattern = Command(), 1
        elif now.argv[:1] == ["for"] and word == "do":
            now = Command()
        elif not now.argv and word in _MIDDLE:
            continue
        elif not now.argv and word in _CLOSE:
            if len(stack) <= base:
                raise ShellError(f"{word} closes nothing")
            stack.pop()
            while stack[base:] and stack[-1] == "not":
                stack.pop()
        elif not now.argv and _ASSIGNMENT.match(word):
            now.assignments.append(word)
            after += more
        else:
            now.argv.append(word)
            after += more
        if now.argv[:1] == ["for"] and kind == "op" and word in (";", "\n"):
            now = Command()
    close("seq")
    if [s for s in stack[base:] if s != "not"]:
        raise ShellError(f"{stack[-1]} isn't closed")
    return [c for c in out if c.argv[:1] not in (["for"], ["case"])]


_WRITING = (">", ">>", ">|", "&>", "&>>", "<>")


def _unwrapped(argv: list[str]) -> tuple[list[str], list[str]]:
    """The command behind wrappers and runners, and their names."""
    names = []
    while argv:
        program = argv[0].rsplit("/", 1)[-1]
        if program in WRAPPERS and len(argv) > 1:
            valued, values = WRAPPERS[program]
            rest = argv[1:]
            while rest and (rest[0].startswith("-") or _ASSIGNMENT.match(rest[0])):
                rest = rest[2:] if rest[0] in valued else rest[1:]
            rest = rest[values:]
        else:
            words = 2 if f"{program} {argv[1] if len(argv) > 1 else ''}" in RUNNERS else 1 if program in RUNNERS else 0
            rest = argv[words:]
            while words and rest and rest[0].startswith("-"):
                rest = rest[1:]
            if not words:
                return argv, names
        if not rest:
            return argv, names
        names.append(program)
        argv = rest
    return argv, names


def _sorted_out(words: list[str], valued: frozenset[str], one_operand: bool) -> tuple[list[str], dict[str, str], list[str], list[str]]:
    """Flags, options with values, operands, and what is left where reading stops after the first operand."""
    flags: list[str] = []
    options: dict[str, str] = {}
    operands: list[str] = []
    words = list(words)
    while words:
        word = words.pop(0)
        if word == "--":  # kept, as it tells a path from a branch
            return [*flags, word], options, operands + words, []
        if word.startswith("--") and "=" in word:
            name, value = word.split("=", 1)
            options[name] = value
        elif word in valued and words:
            options[word] = words.pop(0)
        elif word.startswith("-") and word[1:2] not in ("", "-") and word[1:].isalpha():
            flags += [f"-{letter}" for letter in word[1:]]
        elif word.startswith("-") and word != "-":
            flags.append(word)
        else:
            operands.append(word)
            if one_operand:
                break
    return flags, options, operands, words


def describe(command: Command) -> Command:
    """T5: program and subcommand behind wrappers, flags, options, operands, paths, act and effect.

    A file written to makes the workspace the least effect, whatever the command.
    """
    argv, wrappers = _unwrapped(list(command.argv))
    targets = [target for kind, target in command.redirects if kind in (*_WRITING, "<") and target != "/dev/null"]
    writes = any(kind in _WRITING and target not in ("/dev/null", "1", "2") for kind, target in command.redirects)
    at_least = lambda effect: "workspace" if writes and SEVERITY[effect] < SEVERITY["workspace"] else effect
    if not argv:
        return replace(command, act="shell", effect=at_least("none"), paths=targets, wrappers=wrappers)
    program = name = argv[0].rsplit("/", 1)[-1]
    kind = _KNOWN.get(program)
    role = lambda what: _ROLES.get((what, name), frozenset())
    flags: list[str] = []
    options: dict[str, str] = {}
    words = argv[1:]
    while name in _PARENTS:
        more, valued, first, rest = _sorted_out(words, role("valued"), one_operand=True)
        if not first or f"{name} {first[0]}" not in _KNOWN:
            break
        flags, options, words = flags + more, options | valued, rest
        name = f"{name} {first[0]}"
        kind = _KNOWN[name]
    more, valued, operands, _ = _sorted_out(words, role("valued"), one_operand=False)
    flags, options = flags + more, options | valued
    subcommand = name.partition(" ")[2] or None
    if program in ("python", "python3") and options.get("-m") in _MODULES:
        subcommand = options["-m"]
        kind = _MODULES[subcommand]
    act, effect = (kind.act, kind.effect) if kind else ("other", "unknown")
    given = {*flags, *options}
    if (given | set(operands)) & role("destructive"):
        effect = "destructive"
    if given & role("remote"):
        effect = "remote"
    if kind and kind.paths_from is not None:
        paths = operands[kind.paths_from :]
    else:
        paths = [w for w in operands if act == "vcs" and _like_a_path(w)]
    return replace(
        command, program=program, subcommand=subcommand, flags=flags, options=options, operands=operands, paths=paths + targets, wrappers=wrappers,
        act=act, effect=at_least(effect), forced=bool(set(flags) & role("forced")), known=kind is not None,
    )


def _like_a_path(word: str) -> bool:
    """Among refs and branches a word with a slash or a dot is taken for a path."""
    return ("/" in word or "." in word) and ":" not in word and ".." not in word and not word.startswith(("-", "HEAD", "@", "origin/", "upstream/", "refs/"))


def commands_of(text: str | None) -> list[dict]:
    """Rows for a table function; a text that does not parse is one command of act ``shell``."""
    try:
        found = parse(text or "")
    except ShellError:
        return [{"program": None, "subcommand": None, "act": "shell", "effect": "unknown", "forced": False, "join": "first", "nesting": [], "argv": []}]
    return [{"program": c.program, "subcommand": c.subcommand, "act": c.act, "effect": c.effect, "forced": c.forced, "join": c.join, "nesting": list(c.nesting), "argv": c.argv} for c in found]


FIELDS = ("program", "subcommand", "act", "effect", "forced", "join", "nesting", "argv")
ROW = "array<struct<program:string,subcommand:string,act:string,effect:string,forced:boolean,join:string,nesting:array<string>,argv:array<string>>>"


def shell_commands(column: str) -> Column:
    """A column of commands; the parser runs on Arrow batches and reads equal texts of a batch once."""
    @F.arrow_udf(ROW)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(name, pa.bool_() if name == "forced" else pa.list_(pa.string()) if name in ("nesting", "argv") else pa.string()) for name in FIELDS]))
        coded = texts.dictionary_encode(null_encoding="encode")
        return pa.array(map(commands_of, coded.dictionary.to_pylist()), kind).take(coded.indices)

    return run(column)
