"""The folder that the driver and all executors share; native memory of the driver's JVM."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; where a local session names none, as in tests, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='ticketflow-')}"
        shared_folder.own = folder
    return folder


def trim(spark: SparkSession) -> None:
    """The driver's JVM hands native memory that it has freed back to the system, where it is one that can.

    Compilers, codecs and the threads of exchanges leave it in the allocator's arenas, which neither the heap's
    bound nor its collector reaches.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    given[1] = "systemTrimNativeHeap"
    try:
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the interface, as the server's own class is not open to callers
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass
