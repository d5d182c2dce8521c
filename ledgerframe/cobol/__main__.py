"""python -m ledgerframe.cobol [run|check|build] PROGRAM.cbl [NAME=PATH ...]

run (or no verb) runs a program, check lists what is found in it, build writes PROGRAM.py beside it, or where OUT=PATH says: a script that
runs the program with the source text in it, COPY members and all.
"""

import os
import sys

from pyspark.sql import SparkSession

from .program import Program

SCRIPT = '''"""{name}, made from its source text: python {file} [NAME=PATH ...]"""

from ledgerframe.cobol.__main__ import finished
from ledgerframe.cobol.program import Program

SOURCE = {source!r}

if __name__ == "__main__":
    import sys

    sys.exit(finished(Program(SOURCE), sys.argv[1:]))
'''


def finished(program: Program, bindings: list[str], run: bool = True) -> int:
    """Runs a program without errors, shows what it displayed and its diagnostics; the exit code."""
    bad = any(d.level == "ERROR" for d in program.diagnostics)
    run = run and not bad
    if run:
        program.run(SparkSession.builder.appName(program.name).getOrCreate(), paths=dict(b.split("=", 1) for b in bindings))
        for shown in program.display:
            for line in [shown] if isinstance(shown, str) else (r[0] for r in shown.toLocalIterator()):
                print(line)
    for d in program.diagnostics:
        print(f"{d.level}: {d.text}", file=sys.stderr)
    return int(bad) or int(program.env["RETURN_CODE"].value if run else 0)


def main(arguments: list[str]) -> int:
    verb = arguments.pop(0) if arguments[:1] and arguments[0] in ("run", "check", "build") else "run"
    path, *bindings = arguments
    with open(path) as f:
        program = Program(f.read(), [os.path.dirname(path) or "."])
    out = finished(program, bindings, verb == "run")
    if verb == "build" and not out:
        to = dict(b.split("=", 1) for b in bindings).get("OUT", os.path.splitext(path)[0] + ".py")
        with open(to, "w") as f:
            f.write(SCRIPT.format(name=program.name, file=os.path.basename(to), source=program.text))
    return out


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
