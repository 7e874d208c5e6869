"""Completion scripts and Markdown help, made from the command line's parser."""

from __future__ import annotations

import argparse
import shlex
from collections.abc import Iterator


def commands(p: argparse.ArgumentParser) -> Iterator[tuple[str, str, list[argparse.Action]]]:
    """Name, help and arguments of each command."""
    sub = next(a for a in p._actions if isinstance(a, argparse._SubParsersAction))
    about = {c.dest: c.help or "" for c in sub._choices_actions}
    for name, command in sub.choices.items():
        yield name, about.get(name, ""), command._actions


def _words(actions: list[argparse.Action]) -> list[str]:
    """Options and fixed values that a command takes."""
    return [w for a in actions for w in (a.option_strings or a.choices or [])]


def bash(p: argparse.ArgumentParser) -> str:
    cases = "".join(f"    {name}) words={shlex.quote(' '.join(_words(actions)))} ;;\n" for name, _, actions in commands(p))
    names = " ".join(name for name, _, _ in commands(p))
    return (
        f"_{p.prog}() {{\n  local here=${{COMP_WORDS[COMP_CWORD]}} words=\n"
        f"  if [ \"$COMP_CWORD\" -eq 1 ]; then\n    COMPREPLY=($(compgen -W {shlex.quote(names)} -- \"$here\"))\n    return\n  fi\n"
        f"  case ${{COMP_WORDS[1]}} in\n{cases}  esac\n"
        f"  COMPREPLY=($(compgen -W \"$words\" -- \"$here\") $(compgen -f -- \"$here\"))\n}}\ncomplete -o filenames -F _{p.prog} {p.prog}\n"
    )


def zsh(p: argparse.ArgumentParser) -> str:
    listed = " ".join(shlex.quote(f"{name}:{about}") for name, about, _ in commands(p))
    cases = "".join(f"    {name}) compadd -- {' '.join(map(shlex.quote, _words(actions)))} ;;\n" for name, _, actions in commands(p))
    return (
        f"#compdef {p.prog}\n_{p.prog}() {{\n  local -a names=({listed})\n"
        f"  if (( CURRENT == 2 )); then\n    _describe command names\n    return\n  fi\n"
        f"  case $words[2] in\n{cases}  esac\n  _files\n}}\ncompdef _{p.prog} {p.prog}\n"
    )


def fish(p: argparse.ArgumentParser) -> str:
    out = []
    for name, about, actions in commands(p):
        out.append(f"complete -c {p.prog} -n __fish_use_subcommand -f -a {name} -d {shlex.quote(about)}")
        within = f"complete -c {p.prog} -n '__fish_seen_subcommand_from {name}'"
        for a in actions:
            if a.option_strings:
                flags = " ".join(f"-l {o[2:]}" if o.startswith("--") else f"-s {o[1:]}" for o in a.option_strings)
                out.append(f"{within} {flags}{'' if a.nargs == 0 else ' -r'} -d {shlex.quote(a.help or '')}")
            elif a.choices:
                out.append(f"{within} -f -a {shlex.quote(' '.join(a.choices))}")
    return "\n".join(out) + "\n"


def markdown(p: argparse.ArgumentParser) -> str:
    out = [f"# {p.prog}", p.description or "", "| command | what it does |\n|-|-|\n" + "\n".join(f"| `{name}` | {about} |" for name, about, _ in commands(p))]
    for name, about, actions in commands(p):
        rows = [(", ".join(f"`{o}`" for o in a.option_strings) or f"`{a.dest}`", a.help or ", ".join(a.choices or [])) for a in actions]
        out += [f"## `{p.prog} {name}`", about, "| argument | meaning |\n|-|-|\n" + "\n".join(f"| {k} | {v} |" for k, v in rows)]
    return "\n\n".join(out) + "\n"


#: What writes each shell's completion script.
SHELLS = {"bash": bash, "fish": fish, "zsh": zsh}
