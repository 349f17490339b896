"""Loops in Java beside this file, compiled on the driver by the compiler that Spark has for its own code, as SQL functions."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

PACKAGE = "clusterloom"
#: Jars that this driver has given its applications, by application and sources.
_added: set[tuple] = set()


def _compiled(jvm, sources: tuple[str, ...]) -> dict[str, bytes]:
    """Class files by their paths. All sources are cooked as one: the compiler takes one text."""
    imports, bodies = [], []
    for name in sources:
        text = pkgutil.get_data(__package__, f"{name}.java").decode()
        lines = [line for line in text.split("\n") if not line.startswith("package ")]
        imports += [line for line in lines if line.startswith("import ")]
        bodies += [line for line in lines if not line.startswith("import ")]
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook("\n".join([f"package {PACKAGE};", *dict.fromkeys(imports), *bodies]).replace("public class", "public final class"))
    return {name.replace(".", "/") + ".class": bytes(code) for name, code in compiler.getBytecodes().items()}


def functions(spark: SparkSession, sources: tuple[str, ...], **returned: str) -> dict[str, str]:
    """SQL names of the sources' functions, classes with a Spark Java UDF's interface; returned: their types. Executors get
    the classes from the driver, as a jar."""
    app = (spark.sparkContext.applicationId, sources)
    if app not in _added:
        path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE}-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in _compiled(spark._jvm, sources).items():
                jar.writestr(name, code)
        spark.sql(f"ADD JAR '{path}'").collect()
        _added.add(app)
    names, loader = {}, spark._jsparkSession.sharedState().jarClassLoader()
    for name, kind in returned.items():
        names[name] = f"{PACKAGE}_{name}"
        made = loader.loadClass(f"{PACKAGE}.{name}").getDeclaredConstructor(None).newInstance(None)
        spark._jsparkSession.udf().register(names[name], made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return names
