"""The fixed exploratory reports over a flow table.

Input is a canonical flow table (see ``normalize_log_columns``). Every report is a lazy
DataFrame; rankings break ties on the key so results do not depend on partitioning.
"""
