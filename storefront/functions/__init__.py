"""storefront.functions"""
