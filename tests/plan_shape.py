"""What a query's physical plan looks like, read before it runs."""


def _seq(items):
    return [items.apply(i) for i in range(items.size())]


def nodes(frame):
    """All nodes of the physical plan, top down."""
    frame.sparkSession.sparkContext.setLocalProperty("spark.sql.execution.id", None)
    waiting, found = [frame._jdf.queryExecution().executedPlan()], []
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        found.append(node)
        waiting.extend(_seq(node.children()))
    return found


def exchanges(frame):
    """``(how rows are dealt, names of the columns that cross)`` of every shuffle."""
    return [
        (node.outputPartitioning().toString(), [a.name() for a in _seq(node.output())])
        for node in nodes(frame) if node.nodeName() == "Exchange"
    ]


def count(frame, name):
    return sum(node.nodeName().startswith(name) for node in nodes(frame))
