"""Trees and pointers in a store that only Hadoop's file systems can open."""

from codestrata.sources import snapshot, tree


def _mount(spark, folder, name):
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./at", f"file://{folder}")
    return f"viewfs://{name}/at"


def test_tree_in_any_store(spark, tmp_path):
    made, far = tmp_path / "made", tmp_path / "tree/far"
    (made / "tree").mkdir(parents=True)
    far.mkdir(parents=True)
    (made / "tree/a.c").write_text("int a;\n")
    (made / "Makefile").write_text("VERSION = 6\n")
    (made / "tree/b.c").symlink_to("a.c")
    plain = f"{tmp_path}/plain"  # a path without a scheme
    tree.upload(spark, str(made), plain)
    root = f"{_mount(spark, far, 'trees')}/tree"
    tree.upload(spark, str(made), root)
    want = sorted(tuple(r) for r in tree.read_tree(spark, str(made)).collect())
    assert [(r[0], r[5]) for r in want] == [("Makefile", "indexed"), ("tree/a.c", "parsed"), ("tree/b.c", "symlink")]
    assert sorted(tuple(r) for r in tree.read_tree(spark, plain).collect()) == want
    assert sorted(tuple(r) for r in tree.read_tree(spark, root).collect()) == want


def test_pointers_in_any_store(spark, tmp_path):
    root = _mount(spark, tmp_path, "pointers")
    store = snapshot.Store(spark, root)
    for text in ("one", "two"):
        store.put(f"{root}/pinned", text)
        assert store.read(f"{root}/pinned") == text and store.names(root) == ["pinned"]
