from .miner import MiningResult, mine, mine_high_utility_itemsets, mining_stats

__all__ = ["MiningResult", "mine", "mine_high_utility_itemsets", "mining_stats"]
