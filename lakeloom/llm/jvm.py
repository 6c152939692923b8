"""JVM functions of this package, compiled from source by the compiler that Spark carries for its own code.

A method whose inner loop is a chain of dependent steps, such as an adaptive coder, runs as a Java
function inside the tasks. The driver compiles the source once, puts the classes in a jar in the folder
that all machines share and adds it to the session, which hands it to every executor, later ones too.
"""

from __future__ import annotations

import hashlib
import io
import pkgutil
import zipfile

from pyspark.sql import SparkSession

from lakeloom.llm.common import fresh_folder


def install(spark: SparkSession, resource: str, functions: dict[str, tuple[str, str]]) -> None:
    """Registers functions: name to (class, type of the result). Once a session."""
    source = pkgutil.get_data("lakeloom.llm", resource).decode()
    mark = f"lakeloom.jvm.{resource}"
    version = hashlib.sha256(source.encode()).hexdigest()[:16]
    if spark.conf.get(mark, None) == version:
        return
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as jar:
        classes = compiler.getBytecodes()
        for name in sorted(classes):
            jar.writestr(zipfile.ZipInfo(f"{name.replace('.', '/')}.class"), bytes(classes[name]))
    path = jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, f"{version}.jar"))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    spark.sql(f"ADD JAR '{path.toString()}'")
    # By instance: what registerJavaFunction reads of a class, this compiler does not write.
    session, loader = spark._jsparkSession, jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name, (cls, kind) in functions.items():
        kind = jvm.org.apache.spark.sql.types.DataType.fromDDL(kind)
        session.udf().register(name, loader.loadClass(cls).newInstance(), kind)
    spark.conf.set(mark, version)
