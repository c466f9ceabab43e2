"""Training-data operators: thirteen corpus operations built on the DataFrame API.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library intact.
"""
