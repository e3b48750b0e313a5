"""Small tables for the tests."""


def points(spark, pts, image_id=1):
    return spark.createDataFrame([(image_id, int(y), int(x)) for y, x in pts], "image_id long, y int, x int")


def fragments(spark, rows):
    """rows: (id, class, relative_x, [(y, x), ..])"""
    return spark.createDataFrame(
        [(1, i, c, float(rx), [(int(y), int(x)) for y, x in seg]) for i, c, rx, seg in rows],
        "image_id long, id int, dendrite_type int, relative_x double, segment array<struct<y:int,x:int>>")
