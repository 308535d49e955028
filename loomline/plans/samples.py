"""Small source projects that the code queries run over: path and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS = {
    "flows/shell.py": """import os


def run_cmd(c):
    os.system(c)


def wrapped(c):
    run_cmd("ls " + c)


def quoted(c):
    import shlex
    return shlex.quote(c)


def fixed(c):
    return "constant"


def same(c):
    return c


def read_name():
    name = input()
    return name


def down(c, n):
    if n > 0:
        down(c, n - 1)
    os.popen(c)
""",
    "flows/main.py": """import os
import sys
from flows.shell import down, fixed, quoted, read_name, run_cmd, same, wrapped


def main():
    data = request.args.get("q")
    wrapped(data)
    os.system(same(data))
    os.system(quoted(data))
    os.system(read_name())
    os.system(fixed(data))
    run_cmd("clean")
    down(sys.argv[1], 3)


class Job:
    def __init__(self, text):
        self.text = text

    def load(self):
        self.text = input()

    def start(self):
        eval(self.text)


def branches(flag):
    value = input()
    if flag:
        value = "safe"
    os.system(value)
    value = "again"
    os.system(value)


def always(blob):
    import hashlib
    import pickle
    hashlib.md5(blob)
    return pickle.loads(blob)


def looped(rows):
    last = ""
    for row in rows:
        os.system(last)
        last = request.form.get(row)


def dead():
    return 1
    print("never")
    os.system(input())
""",
}
CALLS = {
    "calls/a.py": """from calls.b import K, helper
import calls.b as other


def main():
    helper()
    local()
    fact(3)
    k = K(1)
    k.step()
    print(other.shared())
    apply(local)


def local():
    helper()


def fact(n):
    return n and n * fact(n - 1)


def shared():
    open("x")


def unused():
    pass
""",
    "calls/b.py": """class Base:
    def step(self):
        pass

    def stop(self):
        pass


class K(Base):
    def __init__(self, n):
        self.n = n

    def run(self):
        self.step()

    def step(self):
        helper()


def helper():
    return other_helper


def shared():
    ping()


def ping():
    pong()


def pong():
    ping()
""",
}
BRANCHES = {
    "branches/all.py": """def tries(x):
    try:
        x = risky(x)
    except ValueError:
        x = 0
    finally:
        print(x)
    return x


def loops(n):
    total = 0
    while n:
        if n == 3 or not total:
            n -= 1
            continue
        total += n
        break
    return total


def matched(v):
    match v:
        case 1:
            r = "one"
        case [a, *b]:
            r = a
        case _:
            r = None
    return r
""",
    "branches/broken.py": "def f(:\n",
}


def files(spark: SparkSession, *projects: dict[str, str]) -> DataFrame:
    """``path`` and ``text`` of the files of some projects."""
    return spark.createDataFrame([(p, t) for project in projects for p, t in project.items()], "path string, text string")
