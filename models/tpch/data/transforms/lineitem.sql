SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice,
       cast(cast(l.l_discount_bps AS decimal(14,4)) / 10000 AS decimal(14,4)) AS l_discount,
       o.o_orderdate
FROM lineitem_raw l JOIN orders o ON l.l_orderkey = o.o_orderkey
