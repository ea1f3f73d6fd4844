"""Functions that the JVM runs, compiled from their source in the session.

Janino, the compiler that Spark uses for its own generated code, compiles a source file on the driver. The classes go
into a jar in the folder that all executors share, from which Spark hands it to each executor, also to those that
start later. An instance is registered as a Java function, so its rows never leave the JVM.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import shared_dir


def _classes(spark: SparkSession, path: Path):
    """The compiled source's class loader; its jar is added to the session's context once."""
    context = spark.sparkContext
    source = path.read_text(encoding="utf-8")
    name = f"{path.stem}-{hashlib.sha256(source.encode()).hexdigest()[:16]}.jar"
    loaded = context.__dict__.setdefault("_skarn_classes", {})
    if name not in loaded:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for entry in compiler.getBytecodes().entrySet():
                z.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        out.write(jar.getvalue())
        out.close()
        context._jsc.addJar(target.toString())
        loaded[name] = compiler.getClassLoader()
    return loaded[name]


def function(spark: SparkSession, path: Path, name: str, **arguments: bool | int) -> Callable[[Column], Column]:
    """A column function of binary to binary: class ``name`` of the source, made with ``arguments``."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = gateway.new_array(jvm.java.lang.Class, len(arguments))
    values = gateway.new_array(jvm.java.lang.Object, len(arguments))
    for k, v in enumerate(arguments.values()):
        kinds[k] = (jvm.java.lang.Boolean if isinstance(v, bool) else jvm.java.lang.Integer).TYPE
        values[k] = v
    made = _classes(spark, path).loadClass(name).getConstructor(kinds).newInstance(values)
    register = "_".join(["skarn", name, *map(str, arguments.values())]).lower()
    spark._jsparkSession.udf().register(register, made, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return lambda column: F.call_function(register, column)
