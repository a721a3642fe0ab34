"""The report queries, grouped by subject.

``sales``      best/worst stores, yearly pivot, headline figures, monthly revenue
``stores``     locations, revenue vs orders, repeat customers, hours, weekdays
``products``   category counts, revenue and shares, sizes, box plots
``customers``  locations, counts, RFM scores and segments
``catalog``    the registry with the test-table parameters
``oracle``     independent SQL of every registered report
"""
