import random

from skeinflow.llm import handwritten as h

W = "amber bold brisk calm ledger orchard parcel quota roster tariff vessel warranty".split()


def code(rng, n=6):
    out = ["import logging", ""]
    for _ in range(n):
        a, b = rng.choice(W), rng.choice(W)
        out += [f"def {a}_{b}({b}, flag=False):", f"    result = client.{a}({b}, limit={rng.randrange(99)})", "    if result is None:", f"        raise ValueError('{a} is {b}')", "    return result", ""]
    return "\n".join(out)


def corpus(rng, n):
    rows = []
    for i in range(n):
        repo = f"repo-{i % 23}"
        kind = i % 8
        name = f"{rng.choice(W)}_{rng.choice(W)}"
        if kind == 0:
            rows.append((repo, f"core/{name}_pb2.py", "python", "# Generated by the wire compiler.  DO NOT EDIT!\n" + code(rng)))
        elif kind == 1:
            rows.append((repo, f"vendor/tinylib/{name}.py", "python", f"# tinylib 1.{i}\n# Copyright (c) 2019 the tinylib authors.\n" + code(rng)))
        elif kind == 2:
            rows.append((repo, f"static/{name}.min.js", "javascript", "".join(f'function {rng.choice("abcdef")}{k}(a,b){{return a?b(a.{rng.choice(W)},{k}):!1}}' for k in range(40))))
        elif kind == 3:
            rows.append((repo, f"core/{name}_table.py", "python", 'ROWS = """\n' + "\n".join(f"{k};{rng.choice(W)};{rng.randrange(9999)}" for k in range(80)) + '\n"""\n'))
        else:
            head = rng.choice(["", f"# Copyright (c) 2025 the {repo} maintainers.\n", "# TODO: this should be auto-generated one day, we still write it by hand.\n"])
            rows.append((repo, f"core/{name}.py", "python", head + code(rng)))
    return rows


def test_classifier_holds_on_other_repositories():
    rng = random.Random(6)
    rows = corpus(rng, 500)
    weights, threshold, report = h.train(rows)
    assert report["seen"]["recall"] > 0.97 and report["seen"]["precision"] > 0.97 and report["masked"]["precision"] > 0.95
    wrong = 0
    for i, (repo, path, lang, text) in enumerate(corpus(random.Random(77), 200)):
        s, v = h.features("new-" + repo, path, lang, text)
        wrong += (float(weights[s] @ v) + float(weights[-1]) > threshold) != (i % 8 < 4)
    assert wrong <= 4
    # Without its notice a minified script or a mere table is still found.
    for row in corpus(random.Random(78), 40):
        if ".min." in row[1] or "_table" in row[1]:
            s, v = h.features(*row[:3], h.masked(row[3]))
            assert float(weights[s] @ v) + float(weights[-1]) > threshold


def test_giveaways():
    assert h.giveaways("r", "a/b.py", "python", "# Diese Datei wurde aus x.toml erzeugt; nicht von Hand bearbeiten.\nx = 1\n") == {"machine"}
    assert h.giveaways("r", "a/b.py", "python", "def f(t):\n    return '# Code generated by ' + t + '. DO NOT EDIT.'\n") == set()
    assert h.giveaways("my-repo", "a.py", "python", "# Copyright (c) 2025 the my-repo maintainers.\nx = 1\n") == set()
    assert h.giveaways("r", "vendors/x.py", "python", "x = 1\n") == set() and "vendored" in h.giveaways("r", "vendor/lib/x.py", "python", "x = 1\n")
    assert h.giveaways("r", "package-lock.json", "json", "{}") == {"lock"}


def test_operator(spark):
    rows = corpus(random.Random(9), 160)
    data = [(i, *r[:3], bytearray(r[3].encode()), len(r[3])) for i, r in enumerate(rows)] + [(900, None, None, None, bytearray(b""), None), (901, "r", "x.py", "python", None, None), (3, *rows[3][:3], bytearray(rows[3][3].encode()), 1)]
    frame = spark.createDataFrame(data, "file_id long, repo string, path string, language string, content binary, size long")
    got = {r.file_id: r.other for r in h.not_handwritten(frame).collect()}
    assert got[900] is False and 901 not in got and len(got) == 161
    assert sum(got[i] != (i % 8 < 4) for i in range(160)) <= 4
    assert h.not_handwritten(frame.limit(0)).count() == 0


def test_threshold_finds_files_without_their_giveaways():
    for seed in (9, 14):
        report = h.train(corpus(random.Random(seed), 300))[2]
        assert report["seen"]["precision"] == report["masked"]["precision"] == 1.0
        assert report["seen"]["recall"] == 1.0 and report["masked"]["recall"] > 0.97


def test_notices_below_a_long_licence():
    licence = "".join(f"// Licence line {k} of many.\n" for k in range(40))
    code = "package x\n\n" + "".join(f"func f{k}() int {{\n\treturn {k}\n}}\n" for k in range(20))
    note = "// Code generated by wiregen. DO NOT EDIT.\n"
    assert h.giveaways("r", "a.go", "go", licence + code) == set()
    for text in (licence + "\n" + note + code, "/*\n" + licence.replace("// ", "") + "*/\n" + note + code, code + note + code, code + note + licence):
        assert h.giveaways("r", "a.go", "go", text) == {"machine"} and "wiregen" not in h.masked(text)
    # What a program writes into other files, and what is said of the code beside it, is no notice.
    for text in (code + "const T = `\n" + note + "`\n" + code, code + "// The table is created automatically.\n" + code):
        assert h.giveaways("r", "a.go", "go", text) == set()
    assert h.giveaways("r", "a.sh", "shell", "x=1\n" * 30 + "cat <<EOF\n# @generated\nEOF\n" + "y=1\n" * 30) == set()
    assert h.giveaways("r", "a.js", "javascript", "a();\n" * 100 + "/*! tinylib v1.2 | MIT */\n" + "b();\n") == {"holder"}


def test_comments_are_read_to_the_end_of_the_file():
    code = "x = 1\n" * 200
    text = '"""Doc\nof the file."""\n' + code + "# below\nT = '''\n# @generated elsewhere\n'''\n/* two\nlines */\n" + code + "// last\n"
    assert h.comments(text).split("\n") == ['"""Doc', 'of the file."""', "# below", "/* two", "lines */", "// last"]
    assert h.comments("cat <<EOF\n# no\nEOF\n# yes\n") == "# yes" and h.comments("") == ""
