"""JavaScript as trees: a parser that reads what bundlers emit, a printer, and what is read off the trees.

Nothing here runs a script. Trees are made in Python on the executors, a script at a time, only for rows that a native
guard let through.
"""
