"""Small inputs for what the driver's tables cannot exercise, with the results worked out by hand."""

from __future__ import annotations

import json

NET = '''import socket
from pkg.base import Base, retry

# how long to wait
TIMEOUT = 5


@retry
def resolve_host(name):
    """Look a host up."""
    return socket.gethostbyname(name)


def connect(name):
    return open_link(resolve_host(name))


def open_link(address):
    return Link(address)


class Link(Base):
    def __init__(self, address):
        self.address = address

    def dial(self):
        self.prepare()
        return connect(self.address)
'''
BASE = '''class Root:
    def prepare(self):
        return self.reset()

    def reset(self):
        return None


class Base(Root):
    def reset(self):
        return super().reset()


def retry(function):
    return function
'''
APP = '''from pkg import net


def main():
    link = net.Link("a")
    link.dial()
    net.connect("b")


main()
'''
FILES = [("pkg/net.py", NET), ("pkg/base.py", BASE), ("app.py", APP)]
CHUNKS = [
    ("app.py", 1, 1, "app", "module"), ("app.py", 4, 7, "main", "function"), ("app.py", 10, 10, "app", "module"),
    ("pkg/base.py", 1, 6, "Root", "class"), ("pkg/base.py", 9, 11, "Base", "class"), ("pkg/base.py", 14, 15, "retry", "function"),
    ("pkg/net.py", 1, 5, "pkg.net", "module"), ("pkg/net.py", 8, 19, "resolve_host, connect, open_link", "group"), ("pkg/net.py", 22, 28, "Link", "class"),
]
EDGES = [
    ("app", "main", "call", 10, "local"), ("main", "Link", "instantiate", 5, "unique"), ("main", "Link.dial", "call", 6, "unique"), ("main", "connect", "call", 7, "unique"),
    ("Root.prepare", "Root.reset", "call", 3, "self"), ("Base.reset", "Root.reset", "call", 11, "base"), ("Base", "Root", "inherit", 9, "local"),
    ("resolve_host", "retry", "decorator", 8, "import"), ("connect", "open_link", "call", 15, "local"), ("connect", "resolve_host", "call", 15, "local"),
    ("open_link", "Link", "instantiate", 19, "local"), ("Link", "Base", "inherit", 22, "import"), ("Link.dial", "Root.prepare", "call", 27, "base"), ("Link.dial", "connect", "call", 28, "local"),
]
ANCESTORS = [("Base", 1, "Root"), ("Link", 1, "Base"), ("Link", 2, "Root")]
SYMBOLS = ["resolve_host", "Link.dial", "`reset()`", "LINK", "nothing"]
FOUND = [("resolve_host", "resolve_host", 0), ("Link.dial", "Link.dial", 0), ("`reset()`", "Root.reset", 1), ("`reset()`", "Base.reset", 1), ("LINK", "Link", 2)]
MISSPELT = ["resolv_host", "lnk"]
SIMILAR = [("resolv_host", 1, "resolve_host"), ("lnk", 1, "Link")]
QUESTIONS = [(0, "What calls resolve_host?"), (1, "How is a link opened?"), (2, "What does Link.dial call?")]
PINS = [(0, 1, "resolve_host, connect, open_link"), (2, 1, "Link")]
IMPACT = [(0, "connect", 1, "resolve_host", 15), (0, "main", 2, "connect", 7), (0, "Link.dial", 2, "connect", 28), (0, "app", 3, "main", 10)]
# with two hits a question: the first question hits the group alone, the second the group and main, the third Link and main
EXPANDED = [
    (0, 1, "main", "main calls connect (line 7)"), (0, 2, "Link", "Link.dial calls connect (line 28)"),
    (1, 1, "Link", "Link.dial calls connect (line 28)"), (1, 2, "retry", "decorator of resolve_host"), (1, 3, "app", "app calls main (line 10)"),
    (2, 1, "resolve_host, connect, open_link", "called by Link.dial"), (2, 2, "Base", "inherit of Link"), (2, 3, "Root", "called by Link.dial"),
]
TRACE = [("callees", 1, 3.0, 0.0, 0.0, 0.5, 0.0, 1.0, 1.0), ("callers", 1, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("(all)", 2, 2.5, 0.0, 0.0, 0.25, 0.0, 1.0, 1.0)]
TRACE_GOLD = [(0, "callers", [("app.py", 7), ("pkg/net.py", 28)]), (2, "callees", [("pkg/base.py", 2), ("pkg/net.py", 14)])]

SECRETS = [("key gsk_abcdefgh12345 leaked", "key [API key hidden] leaked"), ("sk-ABCDEFGH_-9 and sk-short", "[API key hidden] and sk-short"), ("nothing here", "nothing here")]
REWRITE_ANSWER = '1) open a listening port\n\u2022 `Listener` bind address\n* OPEN A LISTENING PORT\nLINE 4: "accept loop"\nno\n- backlog size'
REWRITES = [(0, 0, "open a listening port"), (0, 1, "Listener` bind address"), (0, 2, "accept loop")]
NOTEBOOK = json.dumps(
    {
        "cells": [
            {"cell_type": "code", "source": ["import os\n", "%cd /tmp\n", "print(os.getcwd())"], "outputs": [{"text": "/tmp"}]}, {"cell_type": "markdown", "source": "Some *prose*  \nmore"},
            {"cell_type": "code", "source": []}, {"cell_type": "code", "source": "   "}, {"cell_type": "markdown", "source": [""]}, {"cell_type": "raw", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "!pip list"},
        ]
    }
)
NOTEBOOK_LINES = list(
    enumerate(["# %% cell 1", "import os", "# %cd /tmp", "print(os.getcwd())", "", "# %% [markdown] cell 2", "# Some *prose*", "# more", "", "# %% [raw] cell 6", "# a", "# b", "", "# %% cell 7", "# !pip list"], 1)
)

LOAD = "def load(path):\n    data = read(path)\n    return data"
SHOWN = [
    (0, 1, "a.py", 10, 12, LOAD, "load"), (1, 1, "a.py", 10, 12, LOAD, "load"), (1, 2, "b.py", 1, 3, "x = 1\n\ny = x", ""), (1, 3, "b.py", 6, 7, "z = y\nprint(z)", "Other.show"),
    (3, 1, "a.py", 10, 12, LOAD, "load"), (4, 1, "w.py", 1, 60, "\n".join(f"line {i}" for i in range(1, 61)), ""),
]
ANSWERS = [
    (0, "`load` reads the file [a.py:10-12]."),
    (1, "`missing_name` is set [a.py:10-11]. `other_one` has no source. See [c.py:1-2].\nAll of it [b.py:1-7] prints `zed_value`."),
    (2, "I couldn't find this in the excerpts."),
    (3, "Everything is in 【a.py:10-12】."),
    (4, "Wide [w.py:1-50]."),
]
CITED = [(0, "a.py", 10, 12), (1, "a.py", 10, 11), (1, "c.py", 1, 2), (1, "b.py", 1, 7), (3, "a.py", 10, 12), (4, "w.py", 1, 50)]
REPORTS = [
    (0, 1, "", 1, 1, "", "", "", False, 0, True),
    (1, 3, "c.py:1-2", 3, 2, "missing_name @ a.py:10-11; zed_value @ b.py:1-7", "`other_one` has no source.", "", False, 8, False),
    (2, 0, "", 0, 0, "", "", "", True, 0, True),
    (3, 0, "", 0, 0, "", "", "", False, 3, False),
    (4, 1, "", 0, 0, "", "", "w.py:1-50", False, 0, True),
]
RANGES = [(0, 1, ""), (1, 3, "c.py:1-2; b.py:1-7"), (2, 0, ""), (3, 0, ""), (4, 1, "")]
REVISIONS = [(0, "nothing"), (1, "`missing_name` [a.py:10-11]."), (3, "I could not find it."), (4, "I couldn't find it.")]
REPAIRED = [(0, False), (1, True), (2, False), (3, True), (4, False)]
ANSWER_GOLD = [(0, "why", [("a.py", 11)]), (1, "why", [("b.py", 2)]), (2, "why", [("a.py", 11)]), (3, "why", [("a.py", 11)]), (4, "why", [("w.py", 55)])]
ANSWER_METRICS = [(5, 0.4, 0.8, 0.75, 0.4, 18.888889, 1)]
GOLD_TO_CHECK = [(0, "why", [("app.py", 4)]), (1, "why", [("nofile.py", 1)]), (2, "why", [("app.py", 2)]), (3, "why", [("app.py", 99)])]
GOLD_PROBLEMS = [(1, "missing file nofile.py"), (2, "app.py:2 is out of range or blank"), (3, "app.py:99 is out of range or blank")]
