"""storefront.streaming"""
