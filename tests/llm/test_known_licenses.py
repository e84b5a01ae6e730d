"""Licence files as they are found, with and without titles."""

from codeloom.llm import licenses

MIT = next(t for n, k, t in licenses.KNOWN if n == "MIT" and k == "text")
ISC = next(t for n, k, t in licenses.KNOWN if n == "ISC" and k == "text")
HOLDER = "Copyright (c) 2024 Someone\n\n"


def whole(name):
    import pkgutil

    return pkgutil.get_data("codeloom.llm", f"known/{name}.txt").decode()


def test_usual_files(spark):
    want = [("MIT", f"MIT License\n\n{HOLDER}{MIT}\n"), ("MIT", f"The MIT License (MIT)\n\n{HOLDER}{MIT}"), ("ISC", f"ISC License\n\n{HOLDER}{ISC}\n")]
    want += [(n, whole(n)) for n, _ in licenses.WHOLE]
    want += [("BSD-3-Clause", f"BSD 3-Clause License\n\n{whole('BSD-3-Clause')}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{whole('BSD-2-Clause')}")]
    want += [("BSD-3-Clause", whole("BSD-3-Clause").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")), ("BSD-2-Clause", whole("BSD-2-Clause").replace("* ", "1. ", 1).replace("* ", "2. ", 1))]
    apache = whole("Apache-2.0")
    want += [("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache[apache.index("TERMS AND") :]), ("Apache-2.0", apache.replace("http://", "https://"))]
    want += [(None, apache.replace("perpetual", "brief")), (None, f"MIT License\n\n{HOLDER}"), (None, f"My own title\n\n{MIT}")]
    rows = [(i, t) for i, (_, t) in enumerate(want)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == [n for n, _ in want]


def test_forms_name_one_licence():
    names = {}
    for n, k, t in licenses.KNOWN:
        names.setdefault(licenses.digest(licenses.canonical(t)), set()).add(n)
    assert all(len(x) == 1 for x in names.values())
